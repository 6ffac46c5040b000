"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Features are the distinct character 4- to 6-grams of the lower-cased whole text, hashed to 2^20
buckets. Class counts on the training rows give each bucket its log-count ratio; the `FEATURES`
buckets whose ratio differs most surely from 0 (by its standard error) are kept, each present feature has its
ratio as value, and a logistic regression with an L2 penalty is fitted on these.

Bounds: at most `MAX_LABELLED` labelled rows are used for training (the smallest by hash of doc_id,
so the choice doesn't depend on partitioning). Model and tables have a fixed size (2^20 small integers and
FEATURES weights), so they can be broadcast. Scoring is one pass over whole texts without a shuffle.

Labels are learnt only from rows that `trained_on` admits; labels, lang, source and doc_id are
never features. Defined cases: a null text is empty; an empty text has no features and gets the
score of the intercept; labels without a value are ignored, several for one doc_id are averaged
(0.5 and over is toxic); without any usable label the score is 0, with labels of one class only it
is that class's value. Extra columns pass `remove` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm import common as C

ORDERS = (4, 5, 6)
BITS = 20
FEATURES = 4_096
MAX_LABELLED = 10_000
THRESHOLD = 0.3
TASKS = 24
#: Counts are summed in 2^SLICE_BITS slices of the buckets.
SLICE_BITS = 5
SLICES = 1 << SLICE_BITS
#: Texts are cut into features in chunks of about this many bytes, whose arrays fit in a core's cache.
CHUNK_BYTES = 1 << 16
#: Entries of the training matrix that are worked on at once.
ENTRIES = 1 << 18

#: Lower case of the characters of the basic plane whose lower case is one such character.
_LOWER = np.arange(0x10000, dtype=np.uint32)
for _c in range(0x10000):
    _l = chr(_c).lower()
    if len(_l) == 1 and ord(_l) < 0x10000:
        _LOWER[_c] = ord(_l)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def _grams(chars: np.ndarray, offsets: np.ndarray):
    """For each order the buckets of all n-grams and the texts they start in (n-grams over two texts are left out)."""
    doc = C.owners(offsets)
    h = chars * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint32(0x85EBCA6B) + chars[n - 1 :]
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            bucket = (h * np.uint32(0xC2B2AE35) + np.uint32(n * 0x7D4EB2F)) >> np.uint32(32 - BITS)
            yield bucket, doc[: len(h)], doc[: len(h)] == doc[n - 1 :]


def _chars(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    small = chars < 0x10000
    chars[small] = _LOWER[chars[small]]
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars, starts[offsets]


def features(texts: pa.Array, table: np.ndarray | None):
    """Chunk by chunk: first and last text, and the distinct (text in the chunk, feature) pairs, sorted; a feature is a bucket, or what the table has for it (0: none)."""
    data, offsets = C.flat_text(texts)
    for a, b in C.chunks(offsets, CHUNK_BYTES):
        chars, at = _chars(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        keys = []
        for bucket, doc, inside in _grams(chars, at):
            if table is None:
                keys.append(np.unique((doc[inside].astype(np.int64) << BITS) | bucket[inside]))
            else:
                f = table[bucket]
                sel = np.flatnonzero(f)
                sel = sel[inside[sel]]
                keys.append((doc[sel].astype(np.int64) << BITS) | f[sel])
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield a, b, keys >> BITS, keys & ((1 << BITS) - 1)


class Model:
    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.weights, self.bias = table, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for a, b, docs, feats in features(texts, self.table):
            z[a:b] += np.bincount(docs, self.weights[feats], b - a)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the summed log loss + l2/2 |w|^2, by L-BFGS; the matrix is given by its entries."""
    n, memory = len(y), 8

    parts = [slice(i, i + ENTRIES) for i in range(0, len(rows), ENTRIES)]

    def loss(w):
        z = np.full(n, w[width])
        for part in parts:
            z += np.bincount(rows[part], values[part] * w[cols[part]], n)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        e = p - y
        grad = np.append(l2 * w[:width], e.sum())
        for part in parts:
            grad[:width] += np.bincount(cols[part], values[part] * e[rows[part]], width)
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + l2 / 2 * (w[:width] ** 2).sum()), grad

    w = np.zeros(width + 1)
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w[width] = np.log(rate / (1 - rate))
    value, grad = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, t, r in reversed(pairs):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * t
        if pairs:
            s, t, _ = pairs[-1]
            q *= (s @ t) / (t @ t)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, t, r), a in zip(pairs, reversed(alphas)):
            q += (a - r * (t @ q)) * s
        step, slope = 1.0, -(grad @ q)
        while True:
            new = w - step * q
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, t = new - w, new_grad - grad
        if s @ t > 1e-10:
            pairs = [*pairs[-(memory - 1) :], (s, t, 1 / (s @ t))]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w[:width], float(w[width])


def train(docs: DataFrame, labels: DataFrame, trained_on: Column | None = None, max_labelled: int = MAX_LABELLED, n_features: int = FEATURES) -> Model:
    """A model from labelled documents; trained_on is a condition on doc_id."""
    spark = docs.sparkSession
    trained_on = ~held_out(F.col("doc_id")) if trained_on is None else trained_on
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & trained_on).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    some = spark.createDataFrame(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect(), marks.schema)  # bounded
    rows = C.written(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("y", "text").repartition(TASKS), "toxic-train", small=True)
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    table, empty = np.zeros(1 << BITS, np.uint16), np.zeros(1)
    if not n.get(0) or not n.get(1):
        return Model(table, empty, 500.0 if n.get(1) else -500.0)

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, docs, feats in features(batch.column(1), None):
                for label in (0, 1):
                    np.add.at(sums[label], feats[y[a:b][docs] == label], 1)
        parts = sums.reshape(2, SLICES, -1)
        # most buckets of few texts are 0: packed, the sums of many small partitions take little room where they meet
        pack = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([pack(parts[:, i].tobytes()) for i in range(SLICES)], pa.binary())], names=["slice", "sums"])

    def total(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sums = []
            for own in batch.column(1):
                sums.append(np.zeros(2 << BITS >> SLICE_BITS, np.int64))
                for x in own.values:
                    sums[-1] += np.frombuffer(unpack(x.as_buffer()), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sums], pa.binary())], names=["slice", "sums"])

    # packed arrays of a fixed size, one a task, are summed by slices of the buckets, and the sums fetched once
    sliced = C.mapped(rows, count, "slice long, sums binary").groupBy("slice").agg(F.collect_list("sums").alias("all"))
    sliced = C.mapped(sliced, total, "slice long, sums binary")
    counts = np.concatenate([np.frombuffer(r[1], np.int64).reshape(2, -1) for r in sorted(sliced.collect())], axis=1)
    smooth = counts + 1.0
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    sure = np.abs(ratio) / np.sqrt(1 / smooth[0] + 1 / smooth[1])
    sure[counts.sum(axis=0) < 2] = 0
    best = np.argsort(-sure, kind="stable")[: min(n_features, int((sure > 0).sum()))]
    del counts, smooth, sure
    table[best] = np.arange(1, len(best) + 1)
    values = np.append(0.0, ratio[best])

    def extract(batches):
        for batch in batches:
            lists = []
            for a, b, docs, feats in features(batch.column(1), table):
                bounds = np.searchsorted(docs, np.arange(b - a + 1))
                lists += [feats[i:j].astype(np.uint16).tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary())], names=["y", "f"])

    sample = sorted((r[1], r[0]) for r in C.mapped(rows, extract, "y int, f binary").collect())  # bounded by max_labelled and n_features
    y = np.array([label for _, label in sample], np.float64)
    owner = np.repeat(np.arange(len(sample), dtype=np.int32), [len(f) // 2 for f, _ in sample])
    cols = np.frombuffer(b"".join(f for f, _ in sample), np.uint16).astype(np.int32)
    del sample
    weights, bias = fit_logistic(owner, cols, values[cols].astype(np.float32), y, len(values))
    model = Model(table, weights * values, bias)
    del owner, cols
    C.drop(rows)
    C._release()  # the driver, too, gives its memory back before the next stage
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kept = docs.select("doc_id", "text")
    return C.mapped(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def remove(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, all columns kept."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < threshold))

    return C.mapped(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    model = train(docs, C.read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
