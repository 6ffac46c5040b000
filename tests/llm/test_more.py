"""Cases that the operators' docstrings state: blocks of the benchmark, odd labels, a classifier worked out by hand, folders, stable tables."""

import hashlib
import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.llm import common, decontamination, token_shards, toxicity

from .test_operators import lower


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(30)]
    items += [(5, "another text of the same item that has more than thirteen words in it for sure"), (None, "nameless item"), (31, "short one")]
    return spark.createDataFrame(items, "item_id long, text string"), items


@pytest.fixture(scope="module")
def tainted(spark):
    rows = [(i, " ".join([f"d{i}a"] * 20 + [f"i{i}w{j}" for j in range(2, 18)] + ["tail"] * (i % 4) * 100)) for i in range(30)]
    rows += [(40, "Another TEXT of the same, item that has more than thirteen words in it for sure"), (41, "a nameless item"), (42, "Short, one"), (43, "clean words"), (None, "short one")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 300])
def test_blocks_of_the_benchmark(benchmark, tainted, block):
    """Several broadcast blocks give what one gives, items that share an id count once, a null id is named null."""
    windows = defaultdict(set)
    for item, text in benchmark[1]:
        w = lower(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1):
            windows[tuple(w[i : i + size])].add("null" if item is None else str(item))
    want = []
    for doc, text in tainted[1]:
        w, hit, items = lower(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    items |= found
        want.append((doc, len(w), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontamination.annotate(tainted[0], benchmark[0], block_bytes=block).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert Counter(map(str, map(tuple, got))) == Counter(map(str, want)) and sum(w[2] for w in want) > 300


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 300])
def test_spans_are_cut(benchmark, tainted, block):
    got = {r["doc_id"]: r["text"] for r in decontamination.remove(tainted[0], benchmark[0], "spans", block_bytes=block).collect()}
    assert got[43] == "clean words" and lower(got[42]) == [] and lower(got[41]) == ["a"]
    assert lower(got[4]) == ["d4a"] * 20 and lower(got[1]) == ["d1a"] * 20 + ["tail"] * 100
    with pytest.raises(ValueError):
        decontamination.remove(tainted[0], benchmark[0], "other")


def bucket(gram: str) -> int:
    """A gram's bucket, character by character."""
    codes, mask, h = [ord(c) for c in gram], 2**32 - 1, 0
    h = codes[0] * 0x9E3779B1 & mask
    for c in codes[1:]:
        h = (h * 0x85EBCA6B + c) & mask
        h ^= h >> 15
    return ((h * 0xC2B2AE35 + len(gram) * 0x7D4EB2F) & mask) >> (32 - toxicity.BITS)


def grams(text: str) -> set[int]:
    text = (text or "").lower()
    return {bucket(text[i : i + n]) for n in toxicity.ORDERS for i in range(len(text) - n + 1)}


def test_the_classifier_by_hand(spark):
    """Log-count ratios and the regression, computed plainly: features as sets, weights by Newton's method."""
    rng = np.random.default_rng(4)
    vocabulary = ["river", "stone", "Garden", "ÄPFEL", "Москва", "rotten", "scum", "vile"]
    rows = []
    for i in range(120):
        toxic = int(i % 3 == 0)
        words = rng.choice(vocabulary[: 5 + 3 * toxic], 6).tolist() + (["you scum"] if toxic and i % 2 else [])
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, trained_on=F.lit(True), n_features=200)

    sets = [grams(t) for _, t, _ in rows]
    y = np.array([r[2] for r in rows], float)
    counts = [Counter(g for s, label in zip(sets, y) if label == c for g in s) for c in (0, 1)]
    smooth = [np.array([counts[c][b] for b in range(1 << toxicity.BITS)]) + 1.0 for c in (0, 1)]
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    sure = np.abs(ratio) / np.sqrt(1 / smooth[0] + 1 / smooth[1])
    sure[(smooth[0] + smooth[1]) < 4] = 0
    chosen = np.argsort(-sure, kind="stable")[:200]
    x = np.array([[ratio[b] * (b in s) for b in chosen] + [1.0] for s in sets])
    w, penalty = np.zeros(201), np.append(np.ones(200), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty) + 1e-12 * np.eye(201), x.T @ (p - y) + penalty * w)
    want = 1 / (1 + np.exp(-x @ w))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.abs(np.array([got[i] for i in range(120)]) - want).max() < 0.01


def test_odd_labels(spark):
    """Null labels are ignored, several of one document averaged, one class alone decides; null ids never train."""
    docs = spark.createDataFrame([(i, f"text number {i % 7} of them") for i in range(40)] + [(None, "no id"), (99, None), (98, "")], "doc_id long, text string")

    def scores(rows):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), trained_on=F.lit(True))
        return [r["score"] for r in toxicity.score(docs, model).collect()]

    assert set(scores([(1, None), (None, 1)])) == {1 / (1 + math.exp(500))}
    assert set(scores([(1, 1), (2, 1), (3, None)])) == {1.0}
    assert max(scores([(1, 0), (2, 0)])) < 0.01
    mixed = scores([(i, i % 2) for i in range(40)] + [(4, 1), (4, 1), (5, None)])
    assert len(mixed) == 43 and all(0 < s < 1 for s in mixed)


def test_nothing_to_score(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []


def test_token_shards_of_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "some words"), (2, None), (3, "")], "doc_id long, text string").coalesce(1)
    got = token_shards.materialise(df, f"file://{tmp_path}/s", 8, 4).collect()
    ids = token_shards.encoder(token_shards.default_ranks()).encode_ordinary("some words") + [token_shards.EOT]
    record = np.array(ids + [token_shards.PAD] * (8 - len(ids)), np.uint16).tobytes()
    assert [(r["slot"], r["first_doc"], r["n_tokens"], r["sha256"]) for r in got] == [(0, None, len(ids), hashlib.sha256(record).hexdigest())]


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session, "name")


def test_what_is_a_plain_scan(spark, tables):
    docs = common.read_table(spark, tables, "documents")

    def plain(df):
        return common._plain(df._jdf.queryExecution().optimizedPlan())

    assert plain(docs) and plain(docs.where("doc_id > 3").select("doc_id", F.upper("text")))
    for other in (docs.sample(0.5, 1), docs.limit(5), docs.coalesce(1), docs.where(F.rand() < 0.5), docs.select(F.explode(F.split("text", " "))), docs.distinct(), docs.union(docs), docs.orderBy("text")):
        assert not plain(other)


def test_written_tables_are_deleted(spark):
    table = common.written(spark.range(5), "gone")
    assert table.count() == 5
    common.drop(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(table._folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
