"""op10 where the exact rerank sees a small part of the vectors only."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from metaweave.llm import common, nearest


def stored(spark, folder, x):
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return common.read_table(spark, str(folder), "embeddings")


def results(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    return got


def truth(x, q, top=5):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    score = u @ u[q]
    return [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:top]


@pytest.fixture(scope="module")
def clustered():
    """3000 vectors in 60 clusters: those of a cluster are told apart by the codebooks, or by the rerank."""
    gen = np.random.default_rng(5)
    return (gen.normal(size=(60, 16))[gen.integers(0, 60, 3000)] + 0.5 * gen.normal(size=(3000, 16))).astype(np.float32)


def test_recall_with_a_small_rerank(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "SPREADS", -1e9)
    got = results(nearest.search(stored(spark, tmp_path, clustered), rerank=30))
    assert len(got) == 60
    assert sum(len(set(v) & set(truth(clustered, q))) for q, v in got.items()) >= 0.9 * 5 * len(got)


def test_the_codebooks_make_the_recall(spark, clustered, tmp_path, monkeypatch):
    """With codebooks that tell nothing the measure above fails, so it does prove them."""
    monkeypatch.setattr(nearest, "SPREADS", -1e9)  # no query is asked again of all rows
    monkeypatch.setattr(nearest, "fit", lambda x: np.random.default_rng(0).normal(size=(nearest.BOOKS, nearest.WORDS, x.shape[1])) * 1e3)
    got = results(nearest.search(stored(spark, tmp_path, clustered), rerank=30))
    assert sum(len(set(v) & set(truth(clustered, q))) for q, v in got.items()) < 0.9 * 5 * len(got)


def test_a_large_group_of_near_copies(spark, tmp_path):
    """The codes can't tell a group's members apart: its queries are asked of all rows."""
    gen = np.random.default_rng(6)
    x = gen.normal(size=(3000, 16))
    x[::2] = x[0] + 0.02 * gen.normal(size=(1500, 16))
    x = x.astype(np.float32)
    got = results(nearest.search(stored(spark, tmp_path, x), rerank=30))
    assert len(got) == 60
    assert sum(len(set(v) & set(truth(x, q))) for q, v in got.items()) >= 0.98 * 5 * len(got)


def test_whole_keeps_the_smaller_ids(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(200, 8)).astype(np.float32)
    x[50:180] = x[50]
    df = stored(spark, tmp_path, x)
    got = {}
    for r in nearest.whole(df, df.where("vec_id IN (0, 60, 199)"), 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == {q: set(truth(x, q)) for q in (0, 199)} | {60: {50, 51, 52, 53, 54}}


def test_odd_vectors(spark, tmp_path):
    """Null, mixed lengths, repeated ids: each length is searched apart, a repeated query asks with its smallest vector."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0]), (100, [5.0]), (150, None), (None, [1.0, 0.0]), (3, [1.0, None]), (4, [0.0, 0.0]), (0, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert results(nearest.search(df)) == {0: [2, 1], 50: [51]}
