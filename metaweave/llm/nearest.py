"""Approximate nearest neighbours by additive quantisation.

A vector of unit length is written as a sum of M codewords, one from each of M full-dimensional
codebooks. The codebooks are fitted on a bounded sample (`SAMPLE` vectors, the smallest by hash of their id): residual k-means, then
least-squares updates of all codebooks together. Every vector is encoded by beam search, its codes (a byte each) and the
squared norm of its reconstruction are stored. A query's inner products with all codewords are a lookup table;
an approximate score is the sum of M table entries over the stored norm. The best `RERANK` of a query by
this score are scored again, exactly, with the original vectors in double precision.

Where many rows resemble a query more alike than the codes tell (a large group of near copies), the rerank can't be trusted: if the approximate scores'
errors, as seen in the rerank, could bring a row beyond it among the best, the query is open, and all rows are scored for
it in blocks.

Queries are worked on in blocks of `QUERY_BLOCK` that are broadcast (bounded); each task keeps its best
candidates per query as packed arrays, which are merged in two steps, so no task gets a group that grows with the
number of rows.

Ties: equal scores go to the smaller vec_id, among approximate scores too. Copies of one vector (rows with the same components) score the same,
so only the smallest `top` ids of them can be in a result: no more take places among the `RERANK`, and copies can't push a
nearer vector out.

Defined cases: vectors that are null, zero, or have null or non-finite components take no part; vectors of
different lengths have no cosine, so each length is searched apart. Of rows that share a query's vec_id the smallest vector asks. Rows that share the query's vec_id are its own. Null vec_ids take no part.
With no usable vectors, or a single one, there are no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.llm import common as C

BOOKS = 24
WORDS = 128
BEAM = 4
SAMPLE = 6144
RERANK = 400
QUERY_BLOCK = 4096
MERGE = 32
SEED = 11
#: A query is open while the approximate score of the last reranked row, so many standard deviations of its errors higher, passes that of the last result.
SPREADS = 3.0


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps the norm finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes found by beam search, and squared norms of the reconstructions."""
    m, k, d = books.shape
    n = len(x)
    codes = np.zeros((n, 1, m), np.uint8)
    rest = x[:, None, :]
    for j in range(m):
        norms = (books[j] ** 2).sum(axis=1)
        cost = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ books[j].T + norms  # n, beam, k
        flat = cost.reshape(n, -1)
        b = min(beam if j < m - 1 else 1, flat.shape[1])
        best = np.argpartition(flat, b - 1, axis=1)[:, :b] if b < flat.shape[1] else np.tile(np.arange(b), (n, 1))
        parent, word = best // k, best % k
        codes = np.take_along_axis(codes, parent[:, :, None], axis=1)
        codes[:, :, j] = word
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - books[j][word]
    made = x - rest[:, 0]
    return codes[:, 0], (made * made).sum(axis=1)


def fit(x: np.ndarray, m: int = BOOKS, k: int = WORDS, rounds: int = 8, updates: int = 2, seed: int = SEED) -> np.ndarray:
    """Codebooks from residual k-means, then alternating beam-search codes and least squares."""
    rng = np.random.default_rng(seed)
    books, rest = np.zeros((m, k, x.shape[1])), x.copy()
    for j in range(m):
        centres = rest[rng.choice(len(rest), k, replace=len(rest) < k)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
            n = np.bincount(near, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        books[j] = centres
        near = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
        rest -= centres[near]
    for _ in range(updates):
        codes, _ = encode(x, books)
        hot = np.zeros((len(x), m * k), np.float32)
        for j in range(m):
            hot[np.arange(len(x)), j * k + codes[:, j].astype(np.int64)] = 1
        gram = (hot.T @ hot).astype(float) + 1e-3 * len(x) / (m * k) * np.eye(m * k)
        start = books.reshape(m * k, -1)
        books = (start + np.linalg.solve(gram, hot.T @ (x - hot @ start))).reshape(books.shape)
    return books


def _top(scores: np.ndarray, ids: np.ndarray, r: int) -> np.ndarray:
    """Places of the best r by score, then id."""
    if len(scores) > r:
        edge = np.partition(scores, len(scores) - r)[len(scores) - r]
        sure, tied = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        tied = tied[np.argsort(ids[tied], kind="stable")][: r - len(sure)]
        return np.concatenate([sure, tied])
    return np.arange(len(scores))


_PACKED = np.dtype([("score", "<f4"), ("id", "<i8"), ("copy", "<i8")])


def _few(copies: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the `most` smallest ids of each group of copies, and which of these is the last one allowed; repeated ids of a group count once."""
    order = np.lexsort((ids, copies))
    g, i = copies[order], ids[order]
    new = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
    fresh = new | np.append(True, i[1:] != i[:-1]) if len(g) else new
    order, new = order[fresh], new[fresh]
    at = np.arange(len(order))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return order[nth < most], nth[nth < most] == most - 1


def _merged(blobs: list[bytes], r: int, top: int) -> bytes:
    x = np.frombuffer(b"".join(blobs), _PACKED)
    x = x[_few(x["copy"], x["id"], top)[0]]
    return x[_top(x["score"], x["id"], r)].tobytes()


def _copies(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each vector's components."""
    bits = (x + 0.0).view(np.uint64)  # -0.0 is 0.0
    out = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        out = C.mix(out ^ C.mix(bits[:, j] + np.uint64(j + 1)))
    return out.view(np.int64)


class _Best:
    """The `top` best rows of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, top: int):
        self.top, self.owner, self.score, self.id = top, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(queries, -np.inf)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all queries (rows) with some vectors; -inf is none."""
        n = score.shape[1]
        edge = np.partition(score, n - self.top, axis=1)[:, n - self.top] if n > self.top else np.full(len(score), -np.inf)
        q, v = np.nonzero((score >= np.maximum(edge, self.least)[:, None]) & (score > -np.inf))
        own, val, vec = np.append(self.owner, q), np.append(self.score, score[q, v]), np.append(self.id, ids[v])
        order = np.lexsort((vec, -val, own))
        own, val, vec = own[order], val[order], vec[order]
        first = np.searchsorted(own, own)
        keep = np.arange(len(own)) - first < self.top
        self.owner, self.score, self.id = own[keep], val[keep], vec[keep]
        full = np.flatnonzero(np.bincount(self.owner, minlength=len(self.least)) == self.top)
        last = np.searchsorted(self.owner, full, "right") - 1
        self.least[full] = self.score[last]


def whole(rows: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """query_id and vec_id of the best rows of each query, all rows scored in blocks: queries are broadcast, QUERY_BLOCK at a time, and each task keeps `top` of each."""
    spark, out = rows.sparkSession, "query_id long, vec_id long, score double"
    blocks, found = -(-queries.count() // QUERY_BLOCK), spark.createDataFrame([], out)
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        own = part.column("vec_id").to_numpy()
        shared = spark.sparkContext.broadcast((own, unit(matrix(part.column("embedding").combine_chunks())) if len(own) else np.zeros((0, 1))))

        def scan(batches, shared=shared):
            own, q = shared.value
            best = _Best(len(own), top)
            for batch in batches:
                for i in range(0, len(batch) * bool(len(own)), 1024):
                    some = batch.slice(i, 1024)
                    ids = some.column(0).to_numpy()
                    # equal vectors may differ in the last bits here; they are scored once more in the end
                    score = np.round(q @ unit(matrix(some.column(1))).T, 12)
                    score[own[:, None] == ids[None, :]] = -np.inf
                    best.add(score, ids)
            yield pa.RecordBatch.from_arrays([pa.array(own[best.owner].astype(np.int64)), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

        found = found.unionByName(C.mapped(rows.select("vec_id", "embedding"), scan, out))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "vec_id")


def search(vectors: DataFrame, is_query: Column | None = None, top: int = 5, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest rows by cosine."""
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = sorted(r.d for r in rows.select(F.size("embedding").alias("d")).distinct().collect())
    parts = [_search(rows.where(F.size("embedding") == d), d, is_query, top, rerank) for d in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, length: int, is_query: Column, top: int, rerank: int) -> DataFrame:
    """search among vectors of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # bounded
    books = spark.sparkContext.broadcast(fit(unit(matrix(sample.column("embedding").combine_chunks()))))

    def code(batches):
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                x = matrix(part.column(1))
                codes, norms = encode(unit(x), books.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt(np.maximum(norms, 1e-12)).astype(np.float32)), pa.array(_copies(x))], names=["vec_id", "codes", "norm", "copy"])

    index = C.written(C.mapped(rows, code, "vec_id long, codes binary, norm float, copy long"), "aq-index")
    queries = C.written(rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        ids = part.column("vec_id").to_numpy()
        tables = unit(matrix(part.column("embedding").combine_chunks())) if len(ids) else np.zeros((0, length))
        shared = spark.sparkContext.broadcast((ids, tables))

        def scan(batches, shared=shared):
            own, q = shared.value
            m, k, d = books.value.shape
            best: list[list[bytes]] = [[] for _ in own]
            for batch in batches:
                vec = batch.column(0).to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, m)
                norm = batch.column(2).to_numpy(zero_copy_only=False)
                copy = batch.column(3).to_numpy(zero_copy_only=False)
                few, spare = _few(copy, vec, top + 1)  # one to spare, as the query's own id may be among them
                vec, codes, norm, copy = vec[few], codes[few], norm[few], copy[few]
                for i, query in enumerate(own):
                    lut = (books.value @ q[i]).astype(np.float32)  # books x words
                    score = lut[0][codes[:, 0]].copy()
                    for j in range(1, m):
                        score += lut[j][codes[:, j]]
                    score /= norm
                    mine = vec == query
                    score[spare & ~np.isin(copy, copy[mine]) | mine] = -np.inf
                    sel = _top(score, vec, rerank)
                    sel = sel[score[sel] > -np.inf]
                    x = np.empty(len(sel), _PACKED)
                    x["score"], x["id"], x["copy"] = score[sel], vec[sel], copy[sel]
                    best[i] = [_merged([*best[i], x.tobytes()], rerank, top)]
            names = ["query_id", "best"]
            keep = [i for i in range(len(own)) if best[i]]
            yield pa.RecordBatch.from_arrays([pa.array(own[keep].astype(np.int64)), pa.array([best[i][0] for i in keep], pa.binary())], names=names)

        tops = C.mapped(index, scan, "query_id long, best binary")
        found = tops if found is None else found.unionByName(tops)

    def merge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_merged(x, rerank, top) for x in batch.column(1).to_pylist()], pa.binary())], names=["query_id", "best"])

    for key in (F.pmod(F.spark_partition_id(), F.lit(MERGE)), F.lit(0)):
        found = found.withColumn("part", key).groupBy("query_id", "part").agg(F.collect_list("best").alias("best")).select("query_id", "best").mapInArrow(C.trimmed(merge), "query_id long, best binary")

    def unpack(batches):
        for batch in batches:
            x = [np.frombuffer(b, _PACKED) for b in batch.column(1).to_pylist()]
            n = [len(y) for y in x]
            every = np.concatenate(x) if x else np.zeros(0, _PACKED)
            live = np.isfinite(every["score"])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)[live]), pa.array(every["id"][live].copy()), pa.array(every["score"][live].astype(float))], names=["query_id", "vec_id", "near"])

    def exact(batches):
        for batch in batches:
            v, q = (matrix(batch.column(i)) for i in (2, 3))
            v, q = (x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x for x in (v, q))
            score = (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), batch.column(4)], names=["query_id", "vec_id", "score", "near"])

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(rows.select("vec_id", F.col("embedding").alias("v")), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
        return C.mapped(both.select("query_id", "vec_id", "v", "q", "near"), exact, "query_id long, vec_id long, score double, near double")

    pairs = C.mapped(found, unpack, "query_id long, vec_id long, near double").groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reranked = C.written(scored(pairs).withColumn("rank", F.row_number().over(order)), "reranked")
    # a query is open if rows beyond the rerank could still be among its best, by the spread of its approximate scores about the exact ones
    spread = F.coalesce(F.stddev(F.col("score") - F.col("near")), F.lit(0.0))
    cut = reranked.groupBy("query_id").agg(F.count("*").alias("n"), F.min("near").alias("edge"), spread.alias("spread"), F.avg(F.col("score") - F.col("near")).alias("off"), F.min(F.when(F.col("rank") <= top, F.col("score"))).alias("worst"))
    open_ = C.written(cut.where((F.col("n") >= rerank) & (F.col("edge") + F.col("off") + SPREADS * F.col("spread") > F.col("worst"))).select("query_id"), "open-queries")
    best = reranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
    if not open_.limit(1).count():
        return best
    asked = queries.join(open_.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    again = scored(whole(rows, asked, top).distinct().withColumn("near", F.lit(0.0))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(open_, "query_id", "left_anti").unionByName(again.select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.read_table(spark, sf_dir, "embeddings"))
