"""Schema, plans and metrics, against enumeration by hand on small networks."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from metaweave.functions import significance
from metaweave.operators import groups, permutation
from metaweave.operators import relation as R
from metaweave.operators.network import Network
from metaweave.plans import shapes
from metaweave.plans.schema import Schema
from metaweave.sources import archive, store

GENES = Schema({"G": "Gene", "D": "Disease", "T": "Tissue"}, [("G", "i", "G", "both"), ("G", "a", "D", "both"), ("G", "e", "T", "both"), ("D", "l", "T", "both")])
DIRECTED = Schema({"C": "Compound", "G": "Gene", "SE": "Side effect"}, [("G", "r", "G", "forward"), ("C", "u", "G", "both"), ("C", "c", "SE", "both")])
EXAMPLE = {
    "GiG": [("CXCR4", "IRF1"), ("CXCR4", "ITCH"), ("IL2RA", "IRF1"), ("IRF1", "IRF8"), ("IRF1", "SUMO1")],
    "GaD": [("IRF1", "CD"), ("STAT3", "CD"), ("CXCR4", "MS"), ("IL2RA", "MS"), ("IRF8", "MS"), ("STAT3", "MS")],
    "GeT": [("IRF1", "Leukocyte"), ("IRF1", "Lung")],
    "DlT": [("MS", "Leukocyte")],
}


def build(spark, schema, nodes, edges):
    """edges: {name: {(src, dst): v}}"""
    frames = {m: spark.createDataFrame([(i, f"{m} {i}") for i in ids], "id string, name string") for m, ids in nodes.items()}
    return Network(spark, schema, frames, {n: spark.createDataFrame([(a, b, v) for (a, b), v in e.items()], "src string, dst string, v double") for n, e in edges.items()})


@pytest.fixture(scope="module")
def example(spark):
    edges = {n: dict.fromkeys(e, 1.0) for n, e in EXAMPLE.items()}
    edges["GiG"] |= {(b, a): 1.0 for a, b in EXAMPLE["GiG"]}
    nodes = {"G": ["CXCR4", "IL2RA", "IRF1", "IRF8", "ITCH", "STAT3", "SUMO1"], "D": ["CD", "MS"], "T": ["Leukocyte", "Lung"]}
    return build(spark, GENES, nodes, edges)


def brute(edges, path, damping, distinct=True):
    """Sums of path weights by depth-first search."""
    tables = []
    for s in path.steps:
        e = edges[s.stored] if s.forward else {(b, a): v for (a, b), v in edges[s.stored].items()}
        rows, columns = {}, {}
        for (a, b), v in e.items():
            rows[a] = rows.get(a, 0) + v
            columns[b] = columns.get(b, 0) + v
        tables.append({k: v * rows[k[0]] ** -damping * columns[k[1]] ** -damping for k, v in e.items()})
    out, nodes = {}, path.metanodes

    def walk(seen, weight):
        i = len(seen) - 1
        if i == len(path):
            out[seen[0], seen[-1]] = out.get((seen[0], seen[-1]), 0) + weight
            return
        for (a, b), v in tables[i].items():
            if a == seen[-1] and not (distinct and any(x == b and m == nodes[i + 1] for x, m in zip(seen, nodes))):
                walk([*seen, b], weight * v)

    for s in {a for a, _ in tables[0]}:
        walk([s], 1.0)
    return out


def check(counts, want):
    got = {(r["src"], r["dst"]): r["v"] for r in counts.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12), k


def test_parse_and_inverse():
    p = DIRECTED.metapath("CuGr>GuC")
    assert p.metanodes == ("C", "G", "G", "C") and str(p) == "CuGr>GuC" and str(p.inverse) == "CuG<rGuC"
    assert not p.is_symmetric and DIRECTED.metapath("CcSEcC").is_symmetric and str(DIRECTED.metapath("CcSEcC")) == "CcSEcC"
    assert Schema.from_json(DIRECTED.to_json()).metapath("CcSE").target == "SE"
    with pytest.raises(ValueError):
        DIRECTED.metapath("CxG")


@pytest.mark.parametrize("nodes, kind", [
    ("GG", "short_repeat"), ("GGGG", "four_repeat"), ("GGGGG", "long_repeat"), ("GGGDD", "disjoint"), ("CDG", "no_repeats"), ("DGGDG", "other"),
    ("DGGC", "short_repeat"), ("DGGD", "BAAB"), ("CGDDGA", "BAAB"), ("ADAD", "BABA"), ("CCGCG", "other"), ("CGGGC", "BAAB"), ("CGDGAD", "BABA"),
    ("CCGGC", "other"), ("CGCGC", "other"), ("ECDGAGDC", "BAAB"),
    ("CGDCGD", "other"), ("DGGGGGD", "other"), ("CGDDGC", "BAAB"), ("CCGGDD", "disjoint"), ("ABCBCA", "repeat_around"), ("AABCBC", "disjoint_groups"), ("ABACCB", "interior_complete_group"),
])
def test_category(nodes, kind):
    assert shapes.category(nodes) == kind


SHAPES = "ABC"
FULL = Schema({m: m for m in SHAPES}, [(a, "x", b, "both") for a, b in itertools.combinations_with_replacement(SHAPES, 2)])


def word(nodes):
    return FULL.metapath(nodes[0] + "".join("x" + n for n in nodes[1:]))


@pytest.mark.parametrize("nodes, cuts", [
    ("ABBAC", "AB BB BA AC"), ("BABA", "BA AB BA"), ("AAAA", "AA AA AA"), ("AAA", "AAA"), ("CCABBA", "CC CA ABBA"), ("AABBBCC", "AA AB BBB BC CC"), ("BCABA", "BCA AB BA"), ("ABBBBBA", "AB BBBBB BA"), ("ABCBCA", "AB BCBC CA"),
    ("ABBCB", "AB BBCB"), ("ABBAC", "AB BB BA AC"), ("CBABC", "CB BAB BC"), ("AABBBCC", "AA AB BBB BC CC"), ("CAAAA", "CA AA AA AA"),
    ("CCBBC", "CC CB BB BC"), ("BCAAB", "BCA AA AB"), ("CBBBC", "CB BBB BC"), ("CBABBBCC", "CB BABBB BC CC"), ("CBBBBCB", "CB BBBB BC CB"), ("CBBBCA", "CB BBB BC CA"),
    ("CBABAC", "CB BABA AC"), ("CCBAAB", "CC CB BAAB"), ("CCBABA", "CC CB BABA"), ("ACBBCA", "AC CB BB BC CA"), ("ABC", "ABC"), ("CBBABC", "CB BBAB BC"),
])
def test_segments(nodes, cuts):
    assert ["".join(s.metanodes) for s in shapes.segments(word(nodes))] == cuts.split()


def test_segment_frequency():
    count = shapes.segment_frequency([word("ABBA"), word("AB")])
    assert {str(k): v for k, v in count.items()} == {"AxBxBxA": 1, "AxB": 3, "BxB": 1}
    count = shapes.segment_frequency([word("ABBA"), word("AB")], both_directions=True)
    assert {str(k): v for k, v in count.items()} == {"AxBxBxA": 1, "AxB": 2, "BxB": 1, "BxA": 1}
    parts = [str(p) for p in shapes.all_segments(word("CCBAAB"))]
    assert parts == ["CxCxBxAxAxB", "CxC", "CxB", "BxAxAxB", "BxA", "AxA", "AxB"]


@pytest.fixture(scope="module")
def tangled(spark):
    """Triangles, loops, a hub, an isolated node and random weights."""
    rng = random.Random(5)
    nodes = {m: [f"{m.lower()}{i}" for i in range(4)] for m in SHAPES}
    edges = {}
    for name, s in FULL.metaedges.items():
        e = {}
        for a in nodes[s.source][:3] + nodes[s.source][3:] * (s.source != "A"):
            for b in nodes[s.target]:
                if rng.random() < 0.6 or a.endswith("0"):
                    e[a, b] = rng.random()
                    if s.source == s.target:
                        e[b, a] = e[a, b]
        edges[name] = e
    return build(spark, FULL, nodes, edges), edges


@pytest.mark.parametrize("nodes", "AA AAA AAAA AAAAA ABA ABAB ABBA ABBBA ABCCBA ABCBCA AABCBC ABACCB AABBC BAABAB ABABA ABCABC".split())
@pytest.mark.parametrize("damping", [0.0, 0.5])
def test_exact_path_counts(tangled, nodes, damping):
    network, edges = tangled
    want = brute(edges, word(nodes), damping)
    check(network.dwpc(word(nodes), damping), want)
    if damping:
        check(network.enumerate_paths(word(nodes), damping), want)


@pytest.mark.parametrize("nodes", ["AAA", "ABAB", "ABCCBA"])
def test_split_hubs(tangled, nodes):
    network, edges = tangled
    split = Network(network.spark, network.schema, network.nodes, network._edges, hub_rows=3)
    check(split.dwpc(word(nodes)), brute(edges, word(nodes), 0.5))


def test_a_hub_is_dealt_out(spark):
    """One middle node with most rows: the rows it makes lie in many parts, with the same sums."""
    left = spark.createDataFrame([(i, 0, 1, 1.0) for i in range(300)] + [(i, 1, 2, 0.5) for i in range(5)], "src long, dst long, n long, v double")
    right = spark.createDataFrame([(0, i, 1, 2.0) for i in range(200)] + [(1, 3, 1, 1.0)], "src long, dst long, n long, v double")
    plain, split = ({(r["src"], r["dst"]): (r["n"], r["v"]) for r in R.compose(left, right, rows).collect()} for rows in (None, 1000))
    assert plain == split and len(plain) == 60_000 and plain[2, 3] == (3, 2.5)


@pytest.mark.parametrize("order", ["sequential", "recursive", "chain"])
def test_walk_counts(tangled, order):
    network, edges = tangled
    check(network.dwwc(word("ABCAB"), 0.4, order), brute(edges, word("ABCAB"), 0.4, False))


def test_bound(tangled):
    network, edges = tangled
    exact = brute(edges, word("AAAAA"), 0.5)
    bound = {(r["src"], r["dst"]): r["v"] for r in network.dwpc(word("AAAAA"), 0.5, exact=False).collect()}
    walks = brute(edges, word("AAAAA"), 0.5, False)
    assert all(v <= bound[k] + 1e-9 for k, v in exact.items()) and all(v <= walks[k] + 1e-9 for k, v in bound.items())


def test_known_values(example):
    row = example.dwwc("GiGaD").where("src = 'IRF1' and dst = 'MS'").first()
    assert row["n"] == 3 and math.isclose(row["v"], 0.5 + 32**-0.5)
    rows = example.dwpc("GiGiGiG").collect()
    assert {frozenset((r["src"], r["dst"])) for r in rows} == {frozenset((g, "ITCH")) for g in ("IL2RA", "IRF8", "SUMO1")}
    assert all(math.isclose(r["v"], 0.125) for r in rows) and len(rows) == 6
    assert all(math.isclose(r["v"], 0.47855339, abs_tol=1e-8) for r in example.dwpc("DaGiGaD").collect())


def test_keep_uses_inverse(example):
    example.keep("GiGaD")
    check(example.dwpc("DaGiG"), {(r["src"], r["dst"]): r["v"] for r in R.transpose(example.enumerate_paths("GiGaD")).collect()})
    example.release()


def test_diffusion(spark, example):
    edges = spark.createDataFrame([("a", x, 1.0) for x in "xyz"] + [("b", "x", 1.0), ("b", "y", 1.0), ("c", "x", 1.0)], "src string, dst string, v double")
    for r in R.diffusion_step(edges, 1, 0.5).groupBy("src").agg(F.sum("v").alias("s")).collect():
        assert math.isclose(r["s"], 1)
    scores = {r["id"]: r["score"] for r in example.diffuse("GaD", spark.createDataFrame([("STAT3", 1.0), ("IRF1", 1.0)], "id string, weight double")).collect()}
    assert scores == {"CD": 1.5, "MS": 0.5}


def test_validate(spark):
    for rows in ([], [("a", "b", float("nan"))], [("a", "b", float("inf"))], [(None, "b", 1.0)]):
        with pytest.raises(ValueError):
            R.validate(spark.createDataFrame(rows, "src string, dst string, v double"))


def test_gamma_and_sd(spark):
    q = significance.upper_gamma([1.0, 1.0, 0.5, 50.0, 2.0], [2.5, 0.0, 9.0, 40.0, math.inf])
    assert math.isclose(q[0], math.exp(-2.5), rel_tol=1e-12) and q[1] == 1 and q[4] == 0 and math.isclose(q[2], math.erfc(3), rel_tol=1e-10)
    rows = spark.createDataFrame([(32.0, 8.0, 2), (5.0, 5.0, 1), (50.0, 12.0, 3), (0.0, 0.0, 0)], "q double, s double, n long")
    assert [r[0] for r in rows.select(significance.sd_nonzero(F.col("q"), F.col("s"), F.col("n"))).collect()] == [0.0, None, 1.0, None]


@pytest.mark.parametrize("row, p", [
    ((0, 0.0, 8, 3, 3.0, 0.0), 1.0), ((1, 2.0, 8, 3, 3.0, 0.0), 0.375), ((1, 4.0, 8, 3, 3.0, 0.0), 0.0), ((1, 2.5, 10, 1, 1.0, 1.0), 0.008208),
    ((1, 1.0, 10, 0, None, None), 0.0), ((1, 1.5, 100, 10, 2.0, None), 0.1), ((5, 2.48807892922932, 202969400, 1447786, 3.03334213264993, 0.986636206544574), 0.0048801093094888),
])
def test_p_values(spark, row, p):
    rows = spark.createDataFrame([row], "path_count long, dwpc double, n long, nnz long, mean_nz double, sd_nz double")
    assert math.isclose(significance.with_p_value(rows).first()["p_value"], p, rel_tol=1e-4)


@pytest.mark.parametrize("block", [100_000, 60])
def test_permutation(spark, monkeypatch, block):
    monkeypatch.setattr(permutation, "BLOCK_EDGES", block)
    rng = random.Random(3)
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(30) for b in range(40) if rng.random() < 0.2], "src long, dst long, v double")
    barred = spark.createDataFrame([(0, b) for b in range(40)], "src long, dst long")
    once, again = (permutation.permute(edges, excluded=barred, seed=4).toPandas() for _ in range(2))
    key = ["src", "dst"]
    assert once.sort_values(key, ignore_index=True).equals(again.sort_values(key, ignore_index=True))
    before = edges.toPandas()
    assert not once.duplicated(key).any() and len(once) == len(before)
    for c in key:
        assert once[c].value_counts().to_dict() == before[c].value_counts().to_dict()
    new = set(map(tuple, once[key].to_numpy())) - set(map(tuple, before[key].to_numpy()))
    assert len(new) > 20 and not any(a == 0 for a, _ in new)


@pytest.mark.parametrize("block", [100_000, 60])
def test_permutation_undirected(spark, monkeypatch, block):
    monkeypatch.setattr(permutation, "BLOCK_EDGES", block)
    rng = random.Random(3)
    half = [(a, b) for a in range(40) for b in range(a) if rng.random() < 0.3]
    edges = spark.createDataFrame([(x, y, 1.0) for a, b in half for x, y in ((a, b), (b, a))], "src long, dst long, v double")
    got, before = permutation.permute(edges, True, True, seed=1).toPandas(), edges.toPandas()
    pairs = set(zip(got.src, got.dst))
    assert len(pairs) == len(got) == len(before) and all((b, a) in pairs and a != b for a, b in pairs)
    assert got.src.value_counts().to_dict() == before.src.value_counts().to_dict() and pairs != set(zip(before.src, before.dst))


def test_groups_and_significance(example):
    counts = example.dwpc("GiGaD")
    rows = groups.degree_groups(example, "GiGaD", counts).toPandas()
    assert rows.n.sum() == 14 and rows.nnz.sum() == counts.count() and 0 in set(rows.source_degree)
    mean = groups.mean_of_cells(example, "GiGaD", counts)
    null = groups.permuted_groups(permutation.permute_network(example, 2).values(), "GiGaD", mean)
    out = groups.significance_of(example, "GiGaD", null).toPandas()
    assert len(out) == 14 and out.p_value.dropna().between(0, 1).all() and list(out.columns[-3:]) == ["mean_nz", "sd_nz", "p_value"]
    assert len(groups.pairs(example, "GiG").collect()) == 28 and set(null.toPandas().n_perms) == {2}
    with pytest.raises(Exception, match="no degree group"):
        groups.significance_of(example, "GiGaD", null.where("source_degree > 99")).collect()


def test_store_and_archive(spark, example, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/net")
    s.save(example)
    again = s.load()
    check(again.dwpc("GiGaD"), {(r["src"], r["dst"]): r["v"] for r in example.dwpc("GiGaD").collect()})
    assert [r["position"] for r in again.nodes["G"].orderBy("id").collect()] == list(range(7))
    s.computed(again, "GaDlT")
    assert s.read_counts(again, "TlDaG", "dwwc").count() == example.dwpc("GaDlT").count()
    with pytest.raises(FileNotFoundError):
        s.read_counts(again, "GiGiG")
    s.save_permutation("001", example)
    assert list(s.permutations()) == ["001"]
    store.write_tsv(store.labelled_edges(example), f"file://{tmp_path}/tsv")
    assert store.read_tsv(spark, f"file://{tmp_path}/tsv", store.labelled_edges(example).schema).count() == 19
    root = tmp_path / "net"
    names = archive.members(root, ["nodes/**/*", "edges/**/*"], ["**/*.crc"])
    about, *zips = archive.create(tmp_path / "a.zip", root, names, split_gb=2e-6)
    assert len(zips) > 1 and len(archive.info(zips)) == len(names) and about.exists()
    archive.load(zips[0], tmp_path / "out")
    assert list((tmp_path / "out").rglob("*.parquet"))


@pytest.mark.parametrize("nodes", "CABAC CCABBAC CABABC CABBACB ABCABC CABCABCB CABACBA".split())
def test_products_around_groups(tangled, nodes):
    """Groups with repeated nodes inside longer products, which are opened into terms with signs."""
    network, edges = tangled
    check(network.dwpc(word(nodes)), brute(edges, word(nodes), 0.5))


def test_three_crossed_pairs_are_not_enumerated(tangled, monkeypatch):
    network, edges = tangled
    want = brute(edges, word("ABCABC"), 0.5)
    monkeypatch.setattr(Network, "enumerate_paths", None)
    check(network.dwpc(word("ABCABC")), want)


def test_few_middle_nodes_are_multiplied_in_blocks(tangled, monkeypatch):
    from metaweave.operators import dense, network as module

    network, edges = tangled
    calls, real = [], dense.compose
    monkeypatch.setattr(module, "DENSE_PRODUCTS", -100)
    monkeypatch.setattr(dense, "SOURCES", 2)
    monkeypatch.setattr(dense, "compose", lambda *a: calls.append(a) or real(*a))
    path = word("ABC")
    monkeypatch.setattr(network, "_size", lambda part: (1000.0, 2.0, 2.0))
    check(network.dwpc(path), brute(edges, path, 0.5))
    assert calls


@pytest.mark.parametrize("nodes", ["ABAB", "CABAC"])
def test_no_product_of_all_pairs(spark, monkeypatch, nodes):
    """Many nodes of A between few of others: no product holds all pairs of A."""
    rng = random.Random(2)
    ids = {"A": 60, "B": 3, "C": 3}
    names = {m: [f"{m}{i}" for i in range(n)] for m, n in ids.items()}
    edges = {s: {(x, y): rng.random() for x in names[s[0]] for y in names[s[-1]] if x != y} for s in ("AxB", "AxC")}
    network = build(spark, FULL, names, edges)
    made, real = [], R.compose
    monkeypatch.setattr(R, "compose", lambda *a: made.append(real(*a)) or made[-1])
    check(network.dwpc(word(nodes)), brute(edges, word(nodes), 0.5))
    assert max(r.count() for r in made) <= 180


def test_all_pairs_are_not_joined_to_counts(spark, monkeypatch):
    """Every pair of a symmetric metapath is made block by block: no join by both ends, and the same rows as from a search."""
    from metaweave.operators import cells

    rng = random.Random(4)
    names = {"A": [f"a{i:02}" for i in range(30)], "B": [f"b{i}" for i in range(12)], "C": ["c0"]}
    edges = {s: {(x, y): rng.random() for x in names[s[0]] for y in names[s[-1]] if rng.random() < 0.15} for s in ("AxB", "BxC")}
    network = build(spark, FULL, names, edges)
    for name, value in {"CELLS": 60, "NODES": 8, "ROWS": 20, "PRODUCTS": 3, "OUT": 10}.items():
        monkeypatch.setattr(cells, name, value)
    for path, one_way in ((word("ABA"), True), (word("ABC"), False), (word("CBA"), False), (word("AB"), False)):
        want = brute(edges, path, 0.5)
        mean = sum(want.values()) / (len(names[path.source]) * len(names[path.target])) or 1.0
        rows = groups.pairs(network, path)
        assert all(not ("FullOuter" in line or "LeftOuter" in line) or "src" not in line or "dst" not in line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines())
        got = {(r["source_id"], r["target_id"]): (r["path_count"], r["dwpc"]) for r in rows.collect()}
        assert got.keys() == {(a, b) for a in names[path.source] for b in names[path.target] if a <= b or not one_way}
        for k, (n, v) in got.items():
            assert math.isclose(v, math.asinh(want.get(k, 0) / mean), rel_tol=1e-9) and (n > 0) == (k in want), k


@pytest.mark.parametrize("nodes", ["CABAC", "ABCBA"])
def test_mirrored_paths_shuffle_the_middle_once(tangled, monkeypatch, nodes):
    """There and back by the same metanodes: the last metaedge is weighted by its rows only, once, and nodes in common are taken off."""
    network, edges = tangled
    calls, real = [], R.row_weighted
    monkeypatch.setattr(R, "row_weighted", lambda *a: calls.append(a) or real(*a))
    for damping in (0.0, 0.5):
        check(network.dwpc(word(nodes), damping), brute(edges, word(nodes), damping))
    assert len(calls) == 2


def test_mirrored_path_of_four_metanodes(spark):
    """Nodes between that are reached from several ends, two of them at once too."""
    schema = Schema({m: m for m in "ABCD"}, [(a, "x", b, "both") for a, b in ("AB", "BC", "CD")])
    rng = random.Random(6)
    names = {m: [f"{m}{i}" for i in range(4)] for m in "ABCD"}
    edges = {s: {(x, y): rng.random() for x in names[s[0]] for y in names[s[-1]] if rng.random() < 0.6} for s in ("AxB", "BxC", "CxD")}
    path = schema.metapath("AxBxCxDxCxBxA")
    check(build(spark, schema, names, edges).dwpc(path), brute(edges, path, 0.5))


@pytest.mark.parametrize("damping", [0.0, 0.5])
def test_there_and_back_again_makes_no_product_by_rows(spark, monkeypatch, damping):
    """A metaedge there, back and there again towards few nodes: no product is joined row by row and shuffled, from either end, with few nodes to broadcast or many."""
    from metaweave.operators import network as module
    from metaweave.operators import slices

    schema = Schema({m: m for m in "ABCD"}, [(a, "x", b, "both") for a, b in ("AB", "BC", "CD")])
    rng = random.Random(8)
    names = {m: [f"{m}{i}" for i in range(n)] for m, n in zip("ABCD", (7, 9, 6, 3))}
    edges = {s: {(x, y): rng.random() for x in names[s[0]] for y in names[s[-1]] if rng.random() < 0.5} for s in ("AxB", "BxC", "CxD")}
    monkeypatch.setattr(module, "SLICED_PRODUCTS", 0)
    for name, value in {"TARGETS": 3, "ROWS": 5, "SLICE": 4, "PACKED": 3, "OUT": 2}.items():
        monkeypatch.setattr(slices, name, value)
    monkeypatch.setattr(R, "compose", None)
    for text, broadcast in (("AxBxCxBxCxD", 100), ("DxCxBxCxBxA", 100), ("AxBxCxBxCxD", 0), ("BxCxBxCxD", 0)):
        monkeypatch.setattr(module, "BROADCAST_NODES", broadcast)
        path = schema.metapath(text)
        check(build(spark, schema, names, edges).dwpc(path, damping), brute(edges, path, damping))


def test_slices_are_as_a_product_by_rows(spark, monkeypatch):
    """Signs, sources without a name, nodes in the middle without one, counts beyond 2^52 and beyond 2^63."""
    from metaweave.operators import slices

    rng = random.Random(9)
    a = [(s, m, rng.choice([-2, 1, 3]), rng.random()) for s in [None, *range(20)] for m in [None, *range(12)] if rng.random() < 0.4] + [(99, 50, 1 << 32, 1.0), (99, 51, 3, 1.0)]
    b = [(m, f"t{t}", rng.choice([-1, 2]), rng.random()) for m in [None, *range(12)] for t in range(4) if rng.random() < 0.5] + [(50, "t0", 1 << 28, 1.0), (51, "t0", 5, 1.0)]
    left = spark.createDataFrame(a, "src long, dst long, n long, v double")
    right = spark.createDataFrame(b, "src long, dst string, n long, v double")
    for name, value in {"ROWS": 9, "SLICE": 7, "PACKED": 5, "OUT": 3}.items():
        monkeypatch.setattr(slices, name, value)
    want, got = ({(r["src"], r["dst"]): (r["n"], r["v"]) for r in made.collect()} for made in (R.compose(left, right), slices.compose(left, right, (len(a), len(b)), 4)))
    assert got.keys() == want.keys() and got[99, "t0"][0] == (1 << 60) + 15
    assert all(got[k][0] == n and math.isclose(got[k][1], v) for k, (n, v) in want.items())
    for count in (1, 7, 40):
        keys = spark.createDataFrame([(k,) for k in slices._apart(count)], "key int").select(F.pmod(F.hash("key"), F.lit(count)).alias("p"))
        assert [r["p"] for r in keys.collect()] == list(range(count))
    with pytest.raises(Exception, match="beyond 64 bits"):
        slices.compose(left, right.withColumn("n", F.col("n") * 16), (len(a), len(b)), 4).collect()


def test_one_target_is_cut_by_middle_nodes(spark, monkeypatch):
    """All rows towards one target are no slice of their own, and a result is packed for the next product where it is made."""
    from metaweave.operators import slices

    rng = random.Random(10)
    a = [(s, m, 1, rng.random()) for s in range(20) for m in range(12) if rng.random() < 0.5]
    b = [(m, "t", 2, rng.random()) for m in range(12)]
    before = [(f"s{s}", m, 1, rng.random()) for s in range(6) for m in range(20) if rng.random() < 0.5]
    left, right = spark.createDataFrame(a, "src long, dst long, n long, v double"), spark.createDataFrame(b, "src long, dst string, n long, v double")
    first = spark.createDataFrame(before, "src string, dst long, n long, v double")
    for name, value in {"ROWS": 30, "SLICE": 4, "PACKED": 7, "OUT": 3, "CELLS": 6, "PRODUCTS": 5}.items():
        monkeypatch.setattr(slices, name, value)
    packed = slices.compose(left, right, (len(a), len(b)), 1, sources=20, onward=20)
    assert packed.slices == 5
    made = slices.compose(first, packed, (len(before), 20), 1, sources=6)
    want, got = ({(r["src"], r["dst"]): (r["n"], r["v"]) for r in x.collect()} for x in (R.compose(first, R.compose(left, right)), made))
    assert got.keys() == want.keys() and all(got[k][0] == n and math.isclose(got[k][1], v) for k, (n, v) in want.items())
