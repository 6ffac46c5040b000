"""Matrix files, examples, archives of stores, chunks, the cache and permutations of whole networks."""

import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metaweave.operators import cache, groups, permutation
from metaweave.operators import relation as R
from metaweave.sources import archive, examples, matrices, store


def cells(df):
    return {(r["src"], r["dst"]): r["v"] for r in df.collect()}


@pytest.fixture(scope="module")
def genes(spark):
    return examples.example(spark)


@pytest.mark.parametrize("ending", matrices.ENDINGS)
def test_folder_of_matrices(spark, genes, tmp_path, ending):
    matrices.save_folder(genes, tmp_path, ending)
    again = matrices.load_folder(spark, tmp_path, genes.schema)
    for name in genes.schema.metaedges:
        assert cells(again.edges(name)) == cells(genes.edges(name))
    assert [r["id"] for r in again.node_ids("G").collect()] == sorted(r["id"] for r in genes.nodes["G"].collect())
    row = again.dwwc("GiGaD").where("src = 'IRF1' AND dst = 'Multiple Sclerosis'").first()
    assert row["n"] == 3 and math.isclose(row["v"], 0.5 + 32**-0.5)


@pytest.mark.parametrize("kind", ["csr", "csc", "coo"])
def test_sparse_formats(tmp_path, kind):
    matrix = np.array([[0, 2.5, 0], [1, 0, 0], [0, 0, 0], [0, 4, 7]])
    rows, columns = np.nonzero(matrix)
    path = tmp_path / "m.sparse.npz"
    if kind == "coo":
        np.savez(path, row=rows, col=columns, data=matrix[rows, columns], shape=matrix.shape, format=np.array("coo"))
    else:
        a = matrix if kind == "csr" else matrix.T
        major, minor = np.nonzero(a)
        np.savez(path, indices=minor, indptr=np.searchsorted(major, np.arange(len(a) + 1)), data=a[major, minor], shape=matrix.shape, format=np.array(kind.encode()))
    r, c, v, shape = matrices.read_cells(path)
    made = np.zeros(shape)
    made[r, c] = v
    assert (made == matrix).all()


def test_wrong_matrices_raise(spark, genes, tmp_path):
    matrices.write_cells(tmp_path / "m.npy", np.array([0]), np.array([1]), np.array([1.0]), (2, 2))
    with pytest.raises(ValueError, match="shape"):
        matrices.read_relation(spark, tmp_path / "m.npy", ["a"], ["b", "c"])
    with pytest.raises(FileNotFoundError):
        matrices.load_folder(spark, tmp_path, genes.schema)
    with pytest.raises(ValueError, match="no example"):
        examples.example(spark, "other")


def test_archive_of_a_store(spark, genes, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/net")
    s.save(genes)
    about, path = archive.create_from_store(tmp_path / "all.zip", tmp_path / "net")
    table = pd.read_csv(about, sep="\t")
    assert list(table.columns) == list(archive.COLUMNS) and set(table["compress_type"]) == {"lzma"}
    pd.testing.assert_frame_equal(table, archive.info([path]), check_dtype=False)
    archive.load(f"file://{path}", tmp_path / "again")
    assert cells(store.Store(spark, f"file://{tmp_path}/again").load().dwpc("GiGaD")) == cells(genes.dwpc("GiGaD"))
    with pytest.raises(FileExistsError):
        archive.create_from_store(tmp_path / "all.zip", tmp_path / "net")


def test_split_archives(tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}").write_bytes(random.Random(i).randbytes(1000))
    _, *paths = archive.create(tmp_path / "a.zip", tmp_path, [f"f{i}" for i in range(6)], compression=zipfile.ZIP_STORED, split_gb=1.5e-6)
    assert [p.name for p in paths] == ["a-0000.zip", "a-0001.zip", "a-0002.zip"]
    assert archive.info(paths)["filename"].tolist() == [f"f{i}" for i in range(6)]


def test_chunks_and_largest(spark):
    rows = store.chunked(spark.range(0, 95).withColumnRenamed("id", "id").repartition(7), 10).collect()
    assert sorted((r["chunk"], r["id"]) for r in rows) == [(i // 10, i) for i in range(95)]
    df = spark.createDataFrame([("b", "x", 5), ("a", "y", 5), ("a", "x", 1)], "src string, dst string, n long")
    assert tuple(R.largest(df).first()) == ("a", "y", 5) and R.largest(df.where("n > 9")).count() == 0


def test_cache(genes):
    held = cache.Cache(genes, 10_000, {"GiGaD": 2.0, "GaD": 1.0})
    first = cells(held.get("GiGaD"))
    assert cells(held.get("DaGiG")) == {(b, a): v for (a, b), v in first.items()} and cells(held.get("GiGaD")) == first
    assert held.counts == {"misses": 1, "hits": 2} and 0 < held.bytes <= 10_000
    held.budget = held.bytes
    held.get("GaD")
    held.get("GaD")
    assert held.counts["misses"] == 3 and held.get("GiGaD") is not None and held.counts["hits"] == 3  # worth less, so nothing goes for it
    held.priorities["GaD"] = 3.0
    held.get("GaD")
    assert held.counts["evicted"] == 1
    none = cache.Cache(genes, 0)
    for _ in range(2):
        none.get("GaD")
    assert none.counts == {"misses": 2}
    held.clear()


def test_permuted_network(spark, genes, tmp_path):
    permuted = permutation.permute_network(genes, 3)
    assert list(permuted) == ["001", "002", "003"]
    stats = permutation.network_stats(genes, permuted).collect()
    assert len(stats) == 12 and {r["metaedge"] for r in stats} == set(genes.schema.metaedges) and all(0 <= r["share_unchanged"] <= 1 for r in stats)
    # plans don't grow: each permutation's edges are checkpointed before the next
    plan = permuted["003"].edges("GaD")._jdf.queryExecution().optimizedPlan().toString()
    assert "Scan ExistingRDD" in plan or "LogicalRDD" in plan
    s = store.Store(spark, f"file://{tmp_path}/net")
    s.save(genes)
    for name in ("001", "001"):
        s.save_permutation(name, permuted["001"])
    assert list(s.permutations()) == ["001", "001-backup"]
    assert cells(s.load("001").edges("GaD")) == cells(permuted["001"].edges("GaD"))


def test_nodes_by_degree(genes):
    rows = [tuple(r) for r in groups.nodes_by_degree(genes, "GaD")[0].collect()]
    assert sorted(rows) == [(0, "ITCH"), (0, "SUMO1"), (1, "CXCR4"), (1, "IL2RA"), (1, "IRF1"), (1, "IRF8"), (2, "STAT3")]


def test_float_results(genes):
    exact, rounded = genes.dwpc("GiGaD"), genes.dwpc("GiGaD", dtype="float")
    assert dict(rounded.dtypes)["v"] == "float"
    assert {k: np.float32(v) for k, v in cells(exact).items()} == {k: np.float32(v) for k, v in cells(rounded).items()}
    with pytest.raises(ValueError):
        genes.dwpc("GiGaD", dtype="half")


def test_groups_of_permutations(spark, genes, tmp_path):
    """Sums over permutations against a plain count over all pairs of nodes."""
    permuted = permutation.permute_network(genes, 2)
    mean = groups.mean_of_cells(genes, "GiGaD", genes.dwpc("GiGaD"))
    want = {}
    for network in permuted.values():
        value = cells(network.dwpc("GiGaD"))
        source = {r["id"]: r["degree"] for r in groups.end_degrees(network, "GiGaD")[0].collect()}
        target = {r["id"]: r["degree"] for r in groups.end_degrees(network, "GiGaD")[1].collect()}
        each = {}
        for s, a in source.items():
            for t, b in target.items():
                v = math.asinh(value.get((s, t), 0) / mean)
                n, nnz, total, squares = each.get((a, b), (0, 0, 0.0, 0.0))
                each[a, b] = n + 1, nnz + (v != 0), total + v, squares + v * v
        for k, row in each.items():
            want[k] = tuple(x + y for x, y in zip(want.get(k, (0, 0, 0.0, 0.0, 0)), (*row, 1)))
    got = groups.permuted_groups(permuted.values(), "GiGaD", mean)
    s = store.Store(spark, f"file://{tmp_path}/net")
    s.save_groups("GiGaD", 0.5, got)
    rows = {(r["source_degree"], r["target_degree"]): (r["n"], r["nnz"], r["sum"], r["sum_of_squares"], r["n_perms"]) for r in s.read_groups("GiGaD", 0.5).collect()}
    assert rows.keys() == want.keys()
    for k in want:
        assert rows[k] == pytest.approx(want[k])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_positions_of_many_nodes(spark, kind):
    """More nodes than a sample holds whole: the counts are those of the ranges that are numbered."""
    nodes = spark.range(60_000, numPartitions=6).select((F.col("id") * 7919 % 60_000).cast(kind).alias("id"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows become one range
    spark.conf.set(coalesce, "false")
    try:
        rows = store.with_positions(nodes).collect()
    finally:
        spark.conf.unset(coalesce)
    assert sorted(r["position"] for r in rows) == list(range(60_000))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(r["id"] for r in rows)
