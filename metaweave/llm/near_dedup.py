"""Near-duplicate detection by ProbMinHash, banding and exact verification.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` with A-Z lower-cased; a document's shingles are its runs of `SHINGLE`
words (a text of fewer words, but not none, is one shingle), each with its number of occurrences as weight. Two documents
are linked if the probability Jaccard similarity of their weighted shingles is `SIMILARITY` or more (the Jaccard
similarity of the sets, where no shingle occurs twice); classes are the connected components.

Sketch: each shingle sends arrivals of a Poisson process whose rate is its weight (exponential gaps),
each to a random register; a register keeps its earliest arrival. A document's rounds end as soon as no shingle can
still arrive before the latest register. The probability that a register agrees is the probability Jaccard similarity.
A byte of each of the `REGISTERS` registers is kept.

Texts with equal weighted shingles are one node (128-bit digests), so copies are never paired. Nodes that share a band of `ROWS` registers
meet in a bucket: a pair at 0.8 shares none of `BANDS` bands with a probability of 5e-6. First each bucket's leader, the node
with most neighbours, is compared with the others, exactly, by shingles; links make components. Then, in buckets that hold
several components, every node outside the largest one is compared with all of other components, so no pair that could
join two components is given up, and none inside a component is looked at. These pairs are not made as rows: blocks of at most
about `BLOCK` nodes are compared within a task, where a pair counts at its first common band, and only if so many registers, of its sketches and of `FINE` further
ones, agree as a pair at 0.8 has but with a probability of `MISS`; what passes is compared exactly. If that is much work (over `WORK` comparisons an entry), rounds of
`LEADERS` nodes of each bucket go before it as long as they join components; they change the work, not the classes.

Components are found by label propagation with pointer jumping, written to the shared folder each round. Shingles
are extracted, in a second scan, for candidates only. All joins are on node and bucket ids, in which Spark splits skewed keys.

Defined cases: a null or empty text (no words) is a class of its own row; repeated rows are members of one class; rows without a doc_id
come last in choosing a class id; a class id is the smallest doc_id of the class; an empty table gives no rows. Extra columns are
kept by `deduplicate`, not read by `classes`.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.llm import common as C
from metaweave.llm.decontamination import _NORMAL

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
REGISTERS = 384
#: More registers of the nodes that are compared in blocks.
FINE = 1024
BLOCK = 512
MISS = 1e-6
LEADERS = 8
WORK = 64
_NEVER = np.uint64(2**64 - 1)
_LOW48 = np.uint64((1 << 48) - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, n: int = SHINGLE):
    """Chunk by chunk: first and last text, the sorted distinct (text, shingle) keys (16 bits the text in the chunk, 48 the shingle) and how often each occurs."""
    data, offsets = C.flat_text(column)
    for a, b in C.chunks(offsets):
        part = _NORMAL[data[offsets[a] : offsets[b]]]
        starts, ends, bounds = C.find_words(part != 0, offsets[a : b + 1] - offsets[a])
        words, doc = C.hash_words(part, starts, ends), C.owners(bounds)
        grams = C.hash_grams(words, n)
        inside = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
        hashes, own = [grams[inside]], [doc[: len(grams)][inside]]
        sizes = np.diff(bounds)
        for k in range(1, n):
            short = np.flatnonzero(sizes == k)
            if len(short):
                hashes.append(C.hash_grams(words, k)[bounds[short]])
                own.append(short)
        keys = (np.concatenate(own).astype(np.uint64) << np.uint64(48)) | (np.concatenate(hashes) & _LOW48)
        keys.sort()
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        yield a, b, keys[at], np.diff(np.append(at, len(keys)))


def sketch(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash registers: for each document the 32-bit elements that arrived first. Elements come by document, all documents have some."""
    table = np.full(n_docs * registers, _NEVER)
    time, mean, round_ = np.zeros(len(elements)), 1 / weights, 0
    step = int(np.clip(registers * n_docs // max(1, len(elements)), 1, 64))  # arrivals looked at before the limits are
    while len(elements):
        turns = np.arange(round_ + 1, round_ + step + 1, dtype=np.uint64) * _GOLDEN
        round_ += step
        u = C.mix(elements[:, None] + turns)
        gaps = -np.log1p(-(u >> np.uint64(11)).astype(np.float64) / 2.0**53) * mean[:, None]
        times = np.cumsum(np.concatenate([time[:, None], gaps], axis=1), axis=1)[:, 1:]
        register = ((C.mix(u ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        packed = (times.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (elements & np.uint64(0xFFFFFFFF))[:, None]
        np.minimum.at(table, ((doc * registers)[:, None] + register.astype(np.int64)).ravel(), packed.ravel())
        time = times[:, -1]
        live = doc[np.append(True, doc[1:] != doc[:-1])]
        latest = table.reshape(n_docs, registers)[live].max(axis=1) >> np.uint64(32)
        limit = np.zeros(n_docs)
        limit[live] = np.where(latest == np.uint64(0xFFFFFFFF), np.inf, latest.astype(np.uint32).view(np.float32))
        alive = time < limit[doc]
        doc, elements, time, mean = doc[alive], elements[alive], time[alive], mean[alive]
    return (table & np.uint64(0xFFFFFFFF)).reshape(n_docs, registers)


def signs_of(own: np.ndarray, elements: np.ndarray, weights: np.ndarray, m: int, registers: int) -> np.ndarray:
    """Sketches, a byte a register, of m documents (0 where one has no elements); elements come by document."""
    out = np.zeros((m, registers), np.uint8)
    size = np.bincount(own, minlength=m)
    for c in range(int(size.max(initial=0)).bit_length()):  # by size: documents of few shingles need more arrivals of each
        ids = np.flatnonzero((size >> c) == 1)
        most = max(1, (1 << 18) // max(1 << c, registers))
        for i in range(0, len(ids), most):
            some = ids[i : i + most]
            place = np.full(m, -1)
            place[some] = np.arange(len(some))
            at = place[own] >= 0
            out[some] = sketch(place[own[at]], elements[at], weights[at], len(some), registers) & np.uint64(0xFF)
    return out


def band_keys(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The buckets of sketches (a byte a register)."""
    x = signs[:, : bands * rows].reshape(len(signs), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), x.shape[:2]).copy()
    for first in range(0, rows, 7):
        part = np.zeros(x.shape[:2], np.uint64)
        for r in range(first, min(rows, first + 7)):
            part = (part << np.uint64(8)) | x[:, :, r]
        key = C.mix(key * _GOLDEN ^ part)
    return key.view(np.int64)


def least_agreement(similarity: float, registers: int, miss: float = MISS) -> int:
    """So many equal bytes or more a pair at that similarity has, but with a probability of miss."""
    p = similarity + (1 - similarity) / 256
    return max(0, math.floor(registers * p + NormalDist().inv_cdf(miss) * math.sqrt(registers * p * (1 - p))))


def probability_jaccard(x: np.ndarray, wx: np.ndarray | None, y: np.ndarray, wy: np.ndarray | None) -> float:
    """The sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). Elements sorted, each once; no weights are weights of 1."""
    if wx is None and wy is None:
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common / (len(both) - common) if len(both) else 0.0
    wx, wy = (np.ones(len(e)) if w is None else w.astype(float) for e, w in ((x, wx), (y, wy)))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    p, q = wx[i], wy[j]
    order = np.argsort(-p / q, kind="stable")
    p, q = p[order], q[order]
    above, below = wx.sum() - p.sum() + np.cumsum(p), wy.sum() - np.cumsum(q)
    return float((1 / (above / p + below / q)).sum())


def _scan(docs: DataFrame, scans: C.Scans, registers: int) -> DataFrame:
    """row, doc_id, k1, k2 (digest of the weighted shingles), n (distinct ones) and sketch of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, row = C.partition_id(), 0
        for batch in scans.check(batches, 0, 1, first=True):
            m = len(batch)
            n, k1, k2 = np.zeros(m, np.int64), np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            signs = np.zeros((m, registers), np.uint8)
            small: list[tuple] = []

            for a, b, x, counts in shingles(batch.column(1)):
                own = (x >> np.uint64(48)).astype(np.int64)
                elements = C.mix((x & _LOW48) + np.uint64(0x632BE59BD9B4E019))
                size = np.bincount(own, minlength=b - a)
                n[a:b] = size
                bounds = np.concatenate([[0], np.cumsum(size)])
                weighted = C.mix(elements ^ (counts.astype(np.uint64) * _GOLDEN))
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(weighted ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x1D8AF066, 0x5851F42D)]
                for k, total in zip((k1, k2), sums):
                    k[a:b] = total[bounds[1:]] - total[bounds[:-1]]
                large = (size >= 64)[own]
                if large.any():
                    signs[a:b] = signs_of(own[large], elements[large], counts[large], b - a, registers)
                if not large.all():
                    small.append((own[~large] + a, elements[~large], counts[~large]))
            if small:
                own, elements, counts = (np.concatenate(x) for x in zip(*small))
                ids, place = np.unique(own, return_inverse=True)
                signs[ids] = signs_of(place, elements, counts, len(ids), registers)
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.int64(part) << 40) + row + np.arange(m)), batch.column(0), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n), _binary(signs)],
                names=["row", "doc_id", "k1", "k2", "n", "signs"],
            )
            row += m

    return C.mapped(docs.select("doc_id", "text"), run, f"row long, doc_id {kind}, k1 long, k2 long, n long, signs binary")


def _binary(signs: np.ndarray) -> pa.Array:
    ends = np.arange(len(signs) + 1, dtype=np.int32) * signs.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(signs), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(signs))])


def _bytes(column: pa.Array, registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, registers)


def _sets(docs: DataFrame, scans: C.Scans, wanted: C.Sides) -> DataFrame:
    """node, its shingles (sorted numbers of 8 bytes) and their weights (4 bytes each; null if all are 1) of the wanted rows."""

    def run(batches):
        part, row = C.partition_id(), 0
        batches = scans.check(batches, 0, 1)
        side = wanted.read(part, ["node"])
        if side is None:
            for _ in batches:  # all the same: rows of another partition may have come here
                pass
            return
        rows = np.sort(side[0]) - (np.int64(part) << 40)
        for batch in batches:
            mine = rows[(rows >= row) & (rows < row + len(batch))] - row
            if len(mine):
                nodes, sets, weights = [], [], []
                for a, b, x, counts in shingles(batch.column(1).take(pa.array(mine))):
                    bounds = np.searchsorted(x, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(48))
                    for d in range(b - a):
                        own = slice(bounds[d], bounds[d + 1])
                        nodes.append(int(mine[a + d]) + row + (part << 40))
                        sets.append((x[own] & _LOW48).tobytes())
                        weights.append(None if (counts[own] == 1).all() else counts[own].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(weights, pa.binary())], names=["node", "set", "weights"])
            row += len(batch)

    return C.mapped(docs.select("doc_id", "text"), run, "node long, set binary, weights binary")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those that are so similar."""

    def run(batches):
        for batch in batches:
            ok = [_alike(batch.columns[2:4], i, batch.columns[4:6], i, similarity) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y"), F.col("weights").alias("wy")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x"), F.col("weights").alias("wx")), "a")
    return C.mapped(both.select("a", "b", "x", "wx", "y", "wy"), run, "a long, b long")


def _buckets(heads: DataFrame, bands: int, rows: int, registers: int) -> DataFrame:
    """bucket and node for each band."""

    def run(batches):
        for batch in batches:
            keys = band_keys(_bytes(batch.column(1), registers), bands, rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["bucket", "node"])

    return C.mapped(heads.select("node", "signs"), run, "bucket long, node long")


def _fine(sets: DataFrame, wanted: DataFrame, registers: int) -> DataFrame:
    """node and a second, finer sketch of the wanted nodes."""

    def run(batches):
        for batch in batches:
            x = [np.frombuffer(v, np.uint64) for v in batch.column(1).to_pylist()]
            w = [np.ones(len(e), np.int64) if v is None else np.frombuffer(v, np.uint32).astype(np.int64) for e, v in zip(x, batch.column(2).to_pylist())]
            sizes = [len(e) for e in x]
            elements = C.mix(np.concatenate(x) + np.uint64(0x9FB21C651E98DF25)) if x else np.zeros(0, np.uint64)
            signs = signs_of(np.repeat(np.arange(len(x)), sizes), elements, np.concatenate(w) if w else np.zeros(0), len(x), registers)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(signs)], names=["node", "fine"])

    return C.mapped(sets.join(wanted, "node", "left_semi").select("node", "set", "weights"), run, "node long, fine binary")


def _across(open_: DataFrame, heads: DataFrame, fine: DataFrame, leaders: DataFrame | None, similarity: float, bands: int, rows: int, registers: int) -> DataFrame:
    """Pairs of nodes of different components that may be similar: of each bucket all pairs with a node outside its largest component are looked at, or with one of the
    leaders (bucket, node). open_: bucket, node, comp, out, and size and outside (how many of the bucket, and of these outside)."""
    width, all_outside = registers + FINE, leaders is None
    least = least_agreement(similarity, width)
    known = open_.join(heads.select("node", "signs"), "node").join(fine, "node").withColumn("signs", F.concat("signs", "fine"))

    def blocks(of: DataFrame, count: str, name: str) -> DataFrame:
        place = F.pmod(F.xxhash64("node"), F.ceil(F.col(count) / BLOCK))
        return of.groupBy("bucket", place.alias("block")).agg(F.collect_list(F.struct("node", "comp", "out", "signs")).alias(name)).select("bucket", name)

    outside = known.where("out") if leaders is None else known.join(leaders, ["bucket", "node"], "left_semi")
    both = blocks(outside, "outside", "x").join(blocks(known, "size", "y"), "bucket")

    def run(batches):
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            sides = []
            for k in (1, 2):
                lists = batch.column(k)
                x = lists.flatten()
                ends = (o := lists.offsets.to_numpy()) - o[0]
                sides.append((ends, x.field(0).to_numpy(), x.field(1).to_numpy(), x.field(2).to_numpy(zero_copy_only=False), _bytes(x.field(3), width)))
            (xe, xn, xc, _, xs), (ye, yn, yc, yo, ys) = sides
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                y = slice(ye[i], ye[i + 1])
                step = max(1, (1 << 22) // max(1, (ye[i + 1] - ye[i]) * width))
                for s in range(xe[i], xe[i + 1], step):
                    x = slice(s, min(s + step, xe[i + 1]))
                    same = xs[x, None, :] == ys[None, y, :]
                    ok = (np.count_nonzero(same, axis=2) >= least) & (xc[x, None] != yc[None, y])
                    if all_outside:  # two nodes outside the largest component meet twice
                        ok &= ~yo[None, y] | (xn[x, None] < yn[None, y])
                    p, q = np.nonzero(ok)
                    if len(p):
                        first = same[p, q, : bands * rows].reshape(-1, bands, rows).all(axis=2).argmax(axis=1)
                        mine = band_keys(xs[x][p], bands, rows)[np.arange(len(p)), first] == bucket
                        found.append(np.sort(np.stack([xn[x][p[mine]], yn[y][q[mine]]], axis=1), axis=1))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in (0, 1)], names=["a", "b"])

    pairs = C.mapped(both, run, "a long, b long")
    return pairs if all_outside else pairs.distinct()


def _alike(xs: list[pa.Array], i: int, ys: list[pa.Array], j: int, similarity: float) -> bool:
    """Whether the weighted sets (columns set and weights) at i and j are that similar."""
    (x, wx), (y, wy) = [[column[k].as_buffer() for column in side] for side, k in ((xs, i), (ys, j))]
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    wx, wy = (None if w is None else np.frombuffer(w, np.uint32) for w in (wx, wy))
    return probability_jaccard(x, wx, y, wy) >= similarity - 1e-9


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node of its component) of all nodes with links (a, b)."""
    edges = C.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges", small=True)
    labels = C.written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels", small=True)
    while True:
        # the smallest label of a node and its neighbours, then the label of that label
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        jumped = lower.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp", "left")
        last, labels = labels, C.written(jumped.select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels", small=True)
        C.drop(last)
        if not labels.where("old <> comp").limit(1).count():
            C.drop(edges)
            out = labels.select("node", "comp")
            out._folder = labels._folder
            return out


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS) -> DataFrame:
    """row, doc_id, comp (the class by its first row), class_id, class_size and n_shingles of every document; row is its scan partition and place."""
    member = _members(C.stable(docs.select("doc_id", "text")), C.Scans(docs.sparkSession, "scans"), similarity, bands, rows, registers)
    # both sides are written before they are joined, so that Spark can split a large class
    named = C.written(member.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "named", small=True)
    return member.join(named, "comp").select("row", "doc_id", "comp", "class_id", "class_size", F.col("n").alias("n_shingles"))


def _members(docs: DataFrame, scans: C.Scans, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS) -> DataFrame:
    """row, doc_id, n and comp of every document of a stable table, written."""
    spark = docs.sparkSession
    scanned = C.written(_scan(docs, scans, registers), "sketches", small=True)
    full = scanned.where("n > 0")
    # copies meet in one row, and already in the tasks that scan them
    heads = C.written(full.groupBy("k1", "k2", "n").agg(F.min(F.struct("row", "signs")).alias("first")).select("k1", "k2", "n", F.col("first.row").alias("node"), "first.signs"), "heads", small=True)
    entries = _buckets(heads, bands, rows, registers)
    several = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = C.written(entries.join(several, "bucket").select("bucket", "node", "size"), "buckets", small=True)
    n_entries = buckets.count()
    wanted = C.Sides(spark, "candidates")
    wanted.write(buckets.select("node", F.shiftright("node", 40).cast("int").alias("part")), distinct=True)
    sets = C.written(_sets(docs, scans, wanted), "sets", small=True)
    wanted.drop(spark)

    # neighbours of a node, counted once a bucket: the one with most is likely to resemble all of a group
    neighbours = buckets.groupBy("node").agg(F.sum("size").alias("neighbours"))
    ranked = buckets.join(neighbours, "node")
    lead = ranked.groupBy("bucket").agg(F.max(F.struct("neighbours", "node")).alias("lead")).select("bucket", F.col("lead.node").alias("leader"))
    pairs = buckets.join(lead, "bucket").where("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    links = C.written(_similar(pairs.distinct(), sets, similarity), "links", small=True)
    labels = components(links)
    last, fine = False, None
    while True:
        now = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        parts = now.groupBy("bucket", "comp").agg(F.count("*").alias("part"))
        several = parts.groupBy("bucket").agg(F.max(F.struct("part", "comp")).alias("l"), F.count("*").alias("parts")).where("parts > 1")
        several = C.written(several.select("bucket", F.col("l.comp").alias("largest"), F.col("l.part").alias("inside")), "open-buckets", small=True)
        open_ = now.join(several, "bucket").select("bucket", "node", "comp", "size", (F.col("size") - F.col("inside")).alias("outside"), (F.col("comp") != F.col("largest")).alias("out"))
        work = open_.agg(F.sum(F.when(F.col("out"), F.col("size")))).first()[0] or 0
        if not work:
            break
        last = last or work <= WORK * n_entries
        first = None
        if not last:
            order = W.partitionBy("bucket").orderBy(F.col("neighbours").desc(), "node")
            ranked = open_.where("out").select("bucket", "node").join(neighbours, "node").withColumn("rank", F.row_number().over(order))
            first = ranked.where(F.col("rank") <= LEADERS).select("bucket", "node")
        if fine is None:  # buckets that are open later are open now
            fine = C.written(_fine(sets, open_.select("node"), FINE), "fine-sketches", small=True)
        pairs = C.written(_across(open_, heads, fine, first, similarity, bands, rows, registers), "pairs", small=True)
        found = C.written(_similar(pairs, sets, similarity), "links", small=True)
        some = bool(found.limit(1).count())
        if some:
            links = links.unionByName(found)
            C.drop(labels)
            labels = components(links)
        if last:
            break
        last = not some
    C.drop(buckets, sets)
    nodes = heads.select("k1", "k2", "n", "node").join(labels, "node", "left").select("k1", "k2", "n", F.coalesce("comp", "node").alias("comp"))
    member = full.select("row", "doc_id", "k1", "k2", "n").join(nodes, ["k1", "k2", "n"]).select("row", "doc_id", "n", "comp")
    member = C.written(member.unionByName(scanned.where("n = 0").select("row", "doc_id", "n", F.col("row").alias("comp"))), "members", small=True)
    C.drop(scanned, heads, labels)
    return member


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns kept, with one of each class: the first row (in scan order) of the smallest doc_id."""
    docs, scans = C.stable(docs), C.Scans(docs.sparkSession, "scans")
    ids, text = docs.columns.index("doc_id"), docs.columns.index("text")
    member = _members(docs, scans, similarity)
    # classes of one row stay; of the others the kept row is the smallest by (doc_id, row)
    best = member.groupBy("comp").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"), F.count("*").alias("size"))
    best = C.written(best.where("size > 1").select("comp", "best"), "kept", small=True)
    drop = C.Sides(docs.sparkSession, "dropped")
    drop.write(member.join(best, "comp").where("row <> best").select(F.shiftright("row", 40).cast("int").alias("part"), "row"))
    C.drop(member, best)

    def run(batches):
        part, row = C.partition_id(), 0
        side = drop.read(part, ["row"])
        gone = np.sort(side[0]) - (np.int64(part) << 40) if side is not None else np.zeros(0, np.int64)
        for batch in scans.check(batches, ids, text):
            keep = np.ones(len(batch), bool)
            keep[gone[(gone >= row) & (gone < row + len(batch))] - row] = False
            row += len(batch)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(C.trimmed(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_shingles")
