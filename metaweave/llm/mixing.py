"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in keyed hash order, are one stream, cut into blocks of
`block_words` words. A source's target gives its quota of blocks, exactly: whole passes over all
its blocks, then a last pass over some, of which one may be cut short so that the words agree with the
target to less than one word. A binary tree over the output shards splits these
quotas: at each node the blocks of the left half are drawn by a multivariate hypergeometric, so
every leaf has exact block counts per source. Leaf quotas are consecutive ranks of the source's
keyed permutation (Feistel), hence draws of different shards are disjoint; a second permutation
shuffles the blocks within a shard. All of this is closed form: a worker finds the shard and place of each
block of a document from the plan alone.

Bounds: the plan has one entry per source and shard and is made on the driver for at most
`MAX_SOURCES` sources (more raise an error; nothing is dropped).
Streams are numbered in parallel: documents are dealt out by source and hash bucket, so a source
with a third of all rows is spread over `BUCKETS` groups.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own,
last in order; repeated rows are separate documents; ties in the hash order go by doc_id, then
size (rows equal in these are interchangeable); an empty table gives no rows. A source without words has target 0.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metaweave.llm import common as C
from metaweave.llm.feistel import Permutation

WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
MOST = 2.0
BLOCK_WORDS = 512
SHARDS = 16
BUCKETS = 1024
MAX_SOURCES = 100_000
SEED = 20_260_101
_WORD = r"[^\x20\x09-\x0D]+"
_IS_WORD = C.word_table(C.SPACES)


def targets(sizes: list[int], weights: list[float], budget: float, most: float = MOST) -> list[float]:
    """Shares of the budget by weight; none above `most` times its size, the excess shared again by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = budget
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. Beyond the generator's range, where a count's relative error is below 1e-9 either way, by the normal law of the same mean and variance, rounded."""
    total = good + bad
    if n == 0 or good == 0:
        return 0
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    mean = n * (good / total)
    spread = math.sqrt(max(0.0, mean * (bad / total) * ((total - n) / max(1, total - 1))))
    return min(max(round(rng.normal(mean, spread)), n - bad, 0), good, n)


def _multivariate(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of n, source by source."""
    if len(have) == 0 or int(have.sum()) < 10**9:
        return rng.multivariate_hypergeometric(have, n, method="marginals") if len(have) else have
    out, left = np.zeros_like(have), int(have.sum())
    for i, k in enumerate(have.tolist()):
        left -= k
        out[i] = _drawn(rng, k, left, n)
        n -= int(out[i])
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact block counts, one row per shard, by the splitting tree; shard totals differ by one at most."""
    total = int(quotas.sum())
    room = [total // shards + (j < total % shards) for j in range(shards)]
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid = (a + b) // 2
        left = _multivariate(rng, have, sum(room[a:mid]))
        todo += [(a, mid, left), (mid, b, have - left)]
    return out


class Plan:
    """Which blocks are taken, how often, and where they go."""

    def __init__(self, sources: list[str], sizes: list[int], weights: tuple = WEIGHTS, epochs: float = EPOCHS, most: float = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED):
        self.seed, self.shards, self.sizes = seed, shards, sizes
        self.targets = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], epochs * sum(sizes), most)
        self.block = block_words
        self.number = {s: i for i, s in enumerate(sources)}
        self.n_blocks, self.passes, self.ranks, self.cut = [], [], [], []
        for size, target in zip(sizes, self.targets):
            passes, rest = divmod(min(round(target), int(most * size)), size) if size else (0, 0)
            self.n_blocks.append(-(-size // self.block))
            self.passes.append(passes)
            self.ranks.append(rest // self.block)
            self.cut.append(rest % self.block)
        quotas = np.array([p * n + w + (c > 0) for p, n, w, c in zip(self.passes, self.n_blocks, self.ranks, self.cut)], np.int64)
        self.leaf = split(quotas, shards, np.random.default_rng(seed)) if len(sources) else np.zeros((shards, 0), np.int64)
        self.until = np.cumsum(self.leaf, axis=0)  # draws of a source that shards up to this one have
        self.room = self.leaf.sum(axis=1)
        self.before = np.cumsum(self.leaf, axis=1) - self.leaf  # within a shard, draws of earlier sources

    def rank(self, source: int, block: np.ndarray) -> np.ndarray:
        """Places of blocks in the order they are drawn: full blocks by a keyed permutation, then the short one at the stream's end."""
        full = self.sizes[source] // self.block
        out = np.full(len(block), full, np.int64)
        inside = block < full
        out[inside] = Permutation(full, self.seed * 1_000_003 + source).rank(block[inside])
        return out

    def pieces(self, source: int, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents of one source at `first` of its stream: document, pass, words from, to (within it), shard and place in the shard of all that is taken."""
        block = self.block
        a, b = first // block, np.where(size > 0, (first + size - 1) // block + 1, first // block)
        n = b - a
        doc = np.repeat(np.arange(len(first)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        rank = self.rank(source, k)
        out = []
        for p in range(self.passes[source] + 1):
            end = (k + 1) * block
            if p == self.passes[source]:
                end = np.where(rank < self.ranks[source], end, np.where((rank == self.ranks[source]) & (self.cut[source] > 0), k * block + self.cut[source], 0))
            lo = np.maximum(k * block, first[doc])
            hi = np.minimum(end, (first + size)[doc])
            at = np.flatnonzero(hi > lo)
            draw = p * self.n_blocks[source] + rank[at]
            shard = np.searchsorted(self.until[:, source], draw, "right")
            inner = draw - (self.until[shard, source] - self.leaf[shard, source]) + self.before[shard, source]
            place = np.zeros(len(at), np.int64)
            for j in np.unique(shard):
                sel = shard == j
                place[sel] = Permutation(int(self.room[j]), self.seed * 7_919 + int(j)).rank(inner[sel])
            out.append((doc[at], np.full(len(at), p), lo[at] - first[doc[at]], hi[at] - first[doc[at]], shard, place))
        return tuple(np.concatenate(x) for x in zip(*out))


def _placed(docs: DataFrame, *extra: Column) -> tuple[DataFrame, Plan]:
    """doc_id, extra columns and a struct `mix` (key, size, first) of every document, its place in its source's stream; and the plan. Texts aren't kept."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~"))  # "~" sorts after every "s..."
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(_WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.coalesce(F.crc32("text"), F.lit(0)))
    narrow = C.written(docs.select("doc_id", *extra, key.alias("key"), size.alias("size"), h.alias("h")), "mixing")
    kept = [c for c in narrow.columns if c not in ("key", "size", "h")]
    base = narrow.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    groups = C.written(base.groupBy("key", "bucket").agg(F.sum("size").alias("words")), "mixing-groups")
    sources = groups.groupBy("key").agg(F.sum("words").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: merge sources, or raise MAX_SOURCES and the driver's memory")
    sources = sorted(((r.key, r["size"]) for r in sources), key=lambda x: (x[0] == "~", x[0]))
    plan = Plan([k for k, _ in sources], [s for _, s in sources])
    first = groups.select("key", "bucket", (F.sum("words").over(W.partitionBy("key").orderBy("bucket")) - F.col("words")).alias("first"))
    order = W.partitionBy("key", "bucket").orderBy("h", "doc_id", "size")
    inner = base.withColumn("inner", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = inner.join(first, ["key", "bucket"])
    placed = placed.select(*kept, F.struct("key", "size", (F.col("first") + F.col("inner")).alias("first")).alias("mix"))
    placed._tables = narrow, groups  # what it reads
    return placed, plan


def _by_source(plan: Plan, at: pa.StructArray):
    keys = at.field("key").dictionary_encode()
    names, codes = keys.dictionary.to_pylist(), keys.indices.to_numpy(zero_copy_only=False)
    size, first = (at.field(x).to_numpy(zero_copy_only=False) for x in ("size", "first"))
    for c, name in enumerate(names):
        rows = np.flatnonzero(codes == c)
        yield plan.number[name], rows, plan.pieces(plan.number[name], first[rows], size[rows])


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), n_pieces and pieces_sha256 (of pass, from, to, shard and place of its pieces in `manifest`, by pass and from, as 64-bit little-endian numbers)."""
    placed, plan = _placed(docs)
    plan = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        for batch in batches:
            taken = np.zeros(len(batch), np.int64)
            total, target = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            own, parts = [np.zeros(0, np.int64)], [np.zeros((0, 5), "<i8")]
            for s, rows, (doc, *piece) in _by_source(plan.value, batch.column(1)):
                _, lo, hi, _, _ = piece
                own.append(rows[doc])
                parts.append(np.stack(piece, axis=1).astype("<i8"))
                taken[rows] = np.bincount(doc, hi - lo, len(rows)).astype(np.int64)
                total[rows], target[rows] = plan.value.sizes[s], plan.value.targets[s]
            own, parts = np.concatenate(own), np.concatenate(parts)
            parts = parts[np.lexsort((parts[:, 1], parts[:, 0], own))]
            n = np.bincount(own, minlength=len(batch))
            ends = np.cumsum(n)
            sha = [hashlib.sha256(parts[i:j].tobytes()).hexdigest() for i, j in zip((ends - n).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).field("size"), *(pa.array(x) for x in (total, target, taken, n)), pa.array(sha, pa.string())], names=["doc_id", "size", "source_size", "target", "taken", "n_pieces", "pieces_sha256"])

    return C.mapped(placed, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, source_size long, target double, taken long, n_pieces long, pieces_sha256 string")


def manifest(docs: DataFrame) -> DataFrame:
    """Every piece of the mix: doc_id, pass, words from and to within the document, output shard and place in it."""
    placed, plan = _placed(docs)
    plan = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        for batch in batches:
            for _, rows, (doc, nth, lo, hi, shard, place) in _by_source(plan.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[doc])), *(pa.array(x.astype(np.int64)) for x in (nth, lo, hi, shard, place))], names=["doc_id", "pass", "from", "to", "shard", "place"])

    return C.mapped(placed, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pass long, `from` long, `to` long, shard long, place long")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each piece of `manifest`, its text what is taken (n_chars follows), in order of shard and place.

    Documents are placed as narrow rows and then scanned again: their texts go through one shuffle only, as pieces on the way to their shards.
    """
    docs, own = C.stable(docs), "_mix"
    while own in docs.columns:
        own += "_"
    row = F.monotonically_increasing_id()
    placed, plan = _placed(docs, F.shiftright(row, 33).cast("int").alias("_part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"), F.coalesce(F.crc32("text"), F.lit(0)).alias("_crc"))
    sides = C.Sides(docs.sparkSession, "mixing-places")
    sides.write(placed.select(F.col("_part").alias("part"), F.col("_place").alias("place"), F.col("_crc").alias("crc"), "mix.key", "mix.size", "mix.first"))
    C.drop(*placed._tables)
    total, before = int(plan.room.sum()), np.cumsum(plan.room) - plan.room
    plan = docs.sparkSession.sparkContext.broadcast(plan)
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() in ("bigint", "int") else None
    docs_columns = docs.columns

    def run(batches):
        side, at_row = sides.read(C.partition_id(), ["place", "crc", "key", "size", "first"]), 0
        if side is not None:
            order = np.argsort(side[0], kind="stable")
            side = [x[order] for x in side]
        for batch in batches:
            data, offsets = C.flat_text(batch.column(text_at))
            raw, here = memoryview(data), slice(at_row, at_row + len(batch))
            crcs = [zlib.crc32(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            if side is None or side[0][here].tolist() != list(range(here.start, here.stop)) or side[1][here].tolist() != crcs:
                raise RuntimeError("a partition has other rows than when its documents were placed")
            keys, size, first = (x[at_row : at_row + len(batch)] for x in side[2:])
            at_row += len(batch)
            place = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(size), pa.array(first)], names=["key", "size", "first"])
            parts = [np.zeros((0, 5), np.int64)]
            for _, rows, (doc, nth, lo, hi, shard, inner) in _by_source(plan.value, place):
                parts.append(np.stack([rows[doc], nth, lo, hi, before[shard] + inner], axis=1))
            parts = np.concatenate(parts)
            parts = parts[np.lexsort((parts[:, 2], parts[:, 1], parts[:, 0]))]
            texts, out, at, spans = batch.column(text_at), [], None, None
            for d, _, a, b, _ in parts.tolist():
                if d != at:
                    at, text, spans = d, texts[d].as_py(), None
                if b - a == size[d]:
                    out.append(text)
                    continue
                if spans is None:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    spans = C.find_words(_IS_WORD[raw], np.array([0, len(raw)]))
                out.append(raw[spans[0][a] : spans[1][b - 1]].tobytes().decode())
            rows = pa.array(parts[:, 0])
            columns = [batch.column(i).take(rows) for i in range(len(docs_columns))]
            columns[text_at] = pa.array(out, texts.type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(x) for x in out], columns[chars_at].type)
            key = pa.StructArray.from_arrays([pa.array(parts[:, 4]), pa.array(first[parts[:, 0]] + parts[:, 2])], names=["number", "at"])
            yield pa.RecordBatch.from_arrays([*columns, key], names=[*docs_columns, own])

    pieces = C.mapped(docs, run, StructType(list(docs.schema.fields)).add(own, StructType().add("number", "long").add("at", "long")))
    tasks = C.tasks(docs.sparkSession)
    # a piece's number among all places is known, so equal ranges of places need no sample of the rows
    ordered = pieces.repartitionById(tasks, F.floor(F.col(f"{own}.number") * tasks / max(1, total)).cast("int")).sortWithinPartitions(f"{own}.number", f"{own}.at")
    return ordered.select(*docs_columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(C.read_table(spark, sf_dir, "documents"))
