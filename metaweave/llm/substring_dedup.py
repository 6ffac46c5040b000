"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

A word goes if it is covered by a window of `WINDOW` words whose sequence also starts earlier
(smaller doc_id, or the same document further ahead). One automaton of the whole corpus would not fit anywhere, and
streaming every document past every shard's automaton would be quadratic; so only passages that
can repeat are sent, each to the one shard that can hold its earlier copies:

1. Scan: of every window the smallest hash of its `GRAM`-word grams is an anchor (a minimiser), so equal
   windows have equal anchors. Anchors are counted over the whole corpus; an anchor that occurs again is
   routed to the shard of one of its places (row and block of `BLOCK` words), the one of the smallest hash.
2. Scan: around each such anchor the words that its windows can cover are sent to the anchor's shard, as word
   hashes, neighbouring spans merged. All occurrences of a window meet in one shard.
3. Shard: spans come sorted by document and stream past the shard's automaton. A small counting
   sketch, filled from the spans' windows beforehand, tells windows that occur once from those that can
   repeat; only the latter are matched, and added to the automaton where the match is shorter than the
   window. Memory is bound by the distinct repeated windows of a shard, however many documents share them.
   An anchor that occurs over `HOT` times would bring all its copies to one task: windows with such an anchor
   are sent as hashes (128 bits) instead, each once a batch; an aggregation finds their first places, and each partition gets those of its windows
   that repeat and finds the places in the last scan.
4. Scan: the covered words are taken out.

Texts are never shuffled and no shard is sent to all tasks: routing takes the place of the broadcast. Words are compared by 64-bit
hashes (two different windows agree with a probability of about n^2 / 2^65).

Defined cases: a null text has no words; rows with the same doc_id are ordered by scan partition and
place, null doc_ids come first; texts of fewer than WINDOW words lose nothing; an empty table gives
no rows. Extra columns are not read (`annotate`) or kept (`remove`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm import common as C
from metaweave.llm.automaton import SuffixAutomaton

WINDOW = 20
GRAM = 6
BLOCK = 256
SHARD_ANCHORS = 50_000
SKETCH_BITS = 24
#: An anchor with more occurrences is common; its windows don't go to a shard.
HOT = 4096
CHUNK_BYTES = 1 << 19
_HOT = -1
_IS_WORD = C.word_table(C.SPACES)
_MAX = np.uint64(2**64 - 1)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every `width` neighbours."""
    have = 1
    while have < width:
        add = min(have, width - have)
        x = best(x[: len(x) - add], x[add:])
        have += add
    return x


def minima(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for every window the smallest of its grams (0 where it lies in two texts)."""
    g = C.hash_grams(hashes, gram)
    g = np.where(doc[: len(g)] == doc[gram - 1 :], np.clip(g, np.uint64(1), _MAX - np.uint64(1)), _MAX)
    low = _sliding(g, window - gram + 1, np.minimum)
    return g, np.where(doc[: len(low)] == doc[window - 1 :], low, np.uint64(0))


def anchors(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the smallest of some window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, low = minima(hashes, doc, window, gram)
    pad = np.zeros(window - gram, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), window - gram + 1, np.maximum)
    at = np.flatnonzero((high == g) & (high > 0))
    return at, g[at]


class _Texts:
    """Word hashes of the documents of a batch, chunk by chunk."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = C.flat_text(column)

    def __iter__(self):
        for a, b in C.chunks(self.offsets, CHUNK_BYTES):
            part = self.data[self.offsets[a] : self.offsets[b]]
            starts, ends, bounds = C.find_words(_IS_WORD[part], self.offsets[a : b + 1] - self.offsets[a])
            yield a, b, part, starts, ends, bounds


def _key(place: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return C.mix(fp ^ C.mix(place.astype(np.uint64)))


def repeated(docs: DataFrame, scans: C.Scans, window: int = WINDOW, gram: int = GRAM) -> tuple[C.Sides, C.Sides | None]:
    """For each scan partition of a stable table the covered word ranges of its rows (place, from, to), and those of its windows with common anchors that repeat (hashes and first place)."""
    spark = docs.sparkSession
    texts, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()

    def find(batches):
        part, row = C.partition_id(), 0
        for batch in scans.check(batches, 0, 1, first=True):
            for a, b, data, starts, ends, bounds in _Texts(batch.column(1)):
                doc = C.owners(bounds)
                at, fp = anchors(C.hash_words(data, starts, ends), doc, window, gram)
                line = (np.int64(part) << C.Sides.ROW_BITS) + row + a + doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(line), pa.array((at - bounds[doc[at]]) // BLOCK)], names=["fp", "row", "block"])
            row += len(batch)

    found = C.written(C.mapped(texts, find, "fp long, row long, block long"), "anchors")
    total = found.count()
    shards = max(4 * C.tasks(spark), -(-total // SHARD_ANCHORS))
    # any one place of an anchor names its shard, as long as anchors that occur together mostly agree: the one of the smallest hash
    again = found.groupBy("fp").agg(F.min(F.xxhash64("row", "block")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = C.written(again.select("fp", F.when(F.col("n") > HOT, F.lit(_HOT)).otherwise(F.pmod("first", F.lit(shards))).cast("int").alias("shard")), "repeated-anchors")
    routes = C.Sides(spark, "routes")
    # rows that are the same go after the shuffle by partition, so that Spark can split the join where an anchor is common
    routes.write(found.join(again, "fp").select("fp", "shard", F.shiftright("row", C.Sides.ROW_BITS).cast("int").alias("part"), F.col("row").bitwiseAND(F.lit((1 << C.Sides.ROW_BITS) - 1)).alias("place")), distinct=True)
    common = bool(again.where(F.col("shard") == _HOT).limit(1).count())
    C.drop(found, again)

    def routed(part: int):
        """Sorted keys of a partition's rows and anchors, and their shards."""
        side = routes.read(part, ["place", "fp", "shard"])
        if side is None:
            return None
        keys = _key(side[0], side[1].view(np.uint64))
        order = np.argsort(keys)
        return keys[order], side[2][order]

    def unread(batches):
        for _ in batches:  # all the same: rows of another partition may have come here
            pass

    names = ["shard", "phase", "doc_id", "part", "place", "start", "words"]

    def send(batches):
        part, row = C.partition_id(), 0
        batches, side = scans.check(batches, 0, 1), routed(part)
        if side is None:
            return unread(batches)
        keys, shard_of = side
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, starts, ends, bounds in _Texts(batch.column(1)):
                doc = C.owners(bounds)
                hashes = C.hash_words(data, starts, ends)
                at, fp = anchors(hashes, doc, window, gram)
                if not len(at):
                    continue
                key = _key(row + a + doc[at], fp)
                j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[j] == key) & (shard_of[j] != _HOT)
                at, shard = at[hit], shard_of[j[hit]]
                if not len(at):
                    continue
                order = np.lexsort((at, shard))
                at, shard = at[order], shard[order]
                d = doc[at]
                lo, hi = np.maximum(at - (window - gram), bounds[d]), np.minimum(at + window, bounds[d + 1])
                new = np.append(True, (shard[1:] != shard[:-1]) | (d[1:] != d[:-1]) | (lo[1:] > hi[:-1]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                wide = C.hash_grams(hashes, window) >> np.uint64(64 - SKETCH_BITS)
                rows: list[list] = [[] for _ in names]
                for s, e in zip(first.tolist(), last.tolist()):
                    x, y, k = int(lo[s]), int(hi[e]), int(d[s])
                    if y - x < window:
                        continue
                    for phase, blob in ((0, wide[x : y - window + 1].astype(np.uint32).tobytes()), (1, hashes[x:y].tobytes())):
                        for col, v in zip(rows, (int(shard[s]), phase, ids[a + k], part, row + a + k, x - int(bounds[k]), blob)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int32(), batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=names)
            row += len(batch)

    def send_windows(batches):
        """Of the windows whose anchors are common, each once a batch: 128 bits of hash, the first place by doc_id, row and start, and how often it occurs."""
        part, row = C.partition_id(), 0
        batches, side = scans.check(batches, 0, 1), routed(part)
        if side is None:
            return unread(batches)
        keys = side[0][side[1] == _HOT]
        for batch in batches:
            by_id = pc.sort_indices(pa.table([batch.column(0), pa.array(np.arange(len(batch)))], names=["id", "i"]), sort_keys=[("id", "ascending"), ("i", "ascending")], null_placement="at_start").to_numpy()
            rank = np.empty(len(batch), np.int64)
            rank[by_id] = np.arange(len(batch))
            for a, b, data, starts, ends, bounds in _Texts(batch.column(1)):
                doc = C.owners(bounds)
                if len(doc) < window or not len(keys):
                    continue
                hashes = C.hash_words(data, starts, ends)
                low = minima(hashes, doc, window, gram)[1]
                key = _key(row + a + doc[: len(low)], low)
                at = np.flatnonzero((keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key) & (low > 0))
                h1, h2 = (h[at] for h in window_hashes(hashes, window))
                order = np.lexsort((at, rank[a + doc[at]], h2, h1))
                at, h1, h2 = at[order], h1[order], h2[order]
                new = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(at) else np.zeros(0, np.int64)
                n, at = np.diff(np.append(new, len(at))), at[new]
                out = [pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64)), batch.column(0).take(pa.array(a + doc[at])), pa.array((np.int64(part) << C.Sides.ROW_BITS) + row + a + doc[at]), pa.array(at - bounds[doc[at]]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(out, names=["h1", "h2", "doc_id", "row", "start", "n"])
            row += len(batch)

    spans = C.mapped(texts, send, f"shard int, phase int, doc_id {kind}, part int, place long, start long, words binary")
    sorted_ = spans.repartition("shard").sortWithinPartitions("shard", "phase", "doc_id", "part", "place", "start")

    def match(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
        shard, filled, automaton, whole = None, False, SuffixAutomaton(), set()
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(i).to_pylist() for i in range(len(names))]
            for sh, phase, _, part, place, start, words in zip(*cols):
                if sh != shard:
                    shard, automaton, whole = sh, SuffixAutomaton(), set()
                    if filled:
                        sketch[:] = 0
                if phase == 0:
                    slots, n = np.unique(np.frombuffer(words, np.uint32), return_counts=True)
                    sketch[slots] = np.minimum(sketch[slots] + np.minimum(n, 2), 2)
                    filled = True
                    continue
                x = np.frombuffer(words, np.uint64)
                again = sketch[C.hash_grams(x, window) >> np.uint64(64 - SKETCH_BITS)] >= 2
                if not again.any():
                    continue
                digest = hashlib.blake2b(words, digest_size=16).digest()
                if digest in whole:  # the same span went by before
                    out.append((part, place, start, start + len(x)))
                    continue
                whole.add(digest)
                covered = np.zeros(len(again), bool)
                for s, e in _runs(again):
                    piece = x[s : e + window - 1].tolist()
                    known = np.array(automaton.matches(piece)[window - 1 :]) >= window
                    covered[s:e] = known
                    for p, q in _runs(~known):
                        covered[s + p : s + q] = np.array(automaton.add(piece[p : q + window - 1])[window - 1 :]) >= window
                ends = 0
                for s, e in _runs(covered):
                    first = max(ends, s)
                    ends = e + window - 1
                    out.append((part, place, start + first, start + ends))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*out)) or [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "place", "from", "to"])

    covered = C.Sides(spark, "covered")
    covered.write(C.mapped(sorted_, match, "part int, place long, `from` long, `to` long"))
    if not common:
        routes.drop(spark)
        return covered, None
    windows = C.written(C.mapped(texts, send_windows, f"h1 long, h2 long, doc_id {kind}, row long, start long, n long"), "common-windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "start")).alias("f"), F.sum("n").alias("n")).where("n > 1")
    first = C.written(first.select("h1", "h2", F.col("f.row").alias("first_row"), F.col("f.start").alias("first_start")), "first-windows")
    # each partition gets what repeats of its windows, once, and finds the places itself
    repeats = C.Sides(spark, "repeated-windows")
    repeats.write(windows.select("h1", "h2", F.shiftright("row", C.Sides.ROW_BITS).cast("int").alias("part")).join(first, ["h1", "h2"]), distinct=True)
    C.drop(windows, first)
    routes.drop(spark)
    return covered, repeats


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return C.hash_grams(hashes, window), C.hash_grams(C.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)), window)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _kept(batches, ids: int, at: int, sides: tuple[C.Sides, C.Sides | None], scans: C.Scans, window: int):
    """Of each batch: chunk range, data, word places, bounds and which words are covered."""
    row, part = 0, C.partition_id()
    side = sides[0].read(part, ["place", "from", "to"])
    if side is not None:
        order = np.argsort(side[0], kind="stable")
        side = [x[order] for x in side]
    known = sides[1].read(part, ["h1", "h2", "first_row", "first_start"]) if sides[1] is not None else None
    if known is not None:
        order = np.argsort(known[0].view(np.uint64))
        known = [x[order].view(np.uint64) if k < 2 else x[order] for k, x in enumerate(known)]
    for batch in scans.check(batches, ids, at):
        out = []
        for a, b, data, starts, ends, bounds in _Texts(batch.column(at)):
            change = np.zeros(len(starts) + 1, np.int64)
            if side is not None:
                i, j = np.searchsorted(side[0], [row + a, row + b])
                base = bounds[side[0][i:j] - row - a]
                np.add.at(change, base + side[1][i:j], 1)
                np.add.at(change, base + side[2][i:j], -1)
            if known is not None and len(starts) >= window:
                doc = C.owners(bounds)
                h1, h2 = window_hashes(C.hash_words(data, starts, ends), window)
                j = np.minimum(np.searchsorted(known[0], h1), len(known[0]) - 1)
                place = np.arange(len(h1))
                own = (np.int64(part) << C.Sides.ROW_BITS) + row + a + doc[: len(h1)]
                first = (own == known[2][j]) & (place - bounds[doc[: len(h1)]] == known[3][j])
                hit = np.flatnonzero((known[0][j] == h1) & (known[1][j] == h2) & ~first & (doc[: len(h1)] == doc[window - 1 :]))
                np.add.at(change, hit, 1)
                np.add.at(change, hit + window, -1)
            out.append((a, b, data, starts, ends, bounds, np.cumsum(change[:-1]) > 0))
        yield batch, out
        row += len(batch)


def annotate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) of every document."""
    docs, scans = C.stable(docs.select("doc_id", "text")), C.Scans(docs.sparkSession, "scans")
    covered = repeated(docs, scans, window, gram)

    def run(batches):
        for batch, parts in _kept(batches, 0, 1, covered, scans, window):
            n, gone, sha = [], [], []
            for a, b, data, starts, ends, bounds, cut in parts:
                sums = np.concatenate([[0], np.cumsum(cut)])
                n.append(np.diff(bounds))
                gone.append(sums[bounds[1:]] - sums[bounds[:-1]])
                raw = data.tobytes()
                for d in range(b - a):
                    i, j = int(bounds[d]), int(bounds[d + 1])
                    if i == j:
                        words = []
                    elif not gone[-1][d]:
                        words = raw[starts[i] : ends[j - 1]].split()
                    else:
                        words = [w for s, e in _runs(~cut[i:j]) for w in raw[starts[i + s] : ends[i + e - 1]].split()]
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n or none)), pa.array(np.concatenate(gone or none).astype(np.int64)), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return C.mapped(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents, all columns kept, their covered words cut out of the text (other text stays as it is)."""
    docs, scans = C.stable(docs), C.Scans(docs.sparkSession, "scans")
    covered, ids, at = repeated(docs, scans, window, gram), docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        for batch, parts in _kept(batches, ids, at, covered, scans, window):
            texts = batch.column(at).to_pylist()
            for a, b, data, starts, ends, bounds, cut in parts:
                raw = data.tobytes()
                for d in range(b - a):
                    i, j = int(bounds[d]), int(bounds[d + 1])
                    if cut[i:j].any():
                        texts[a + d] = " ".join(raw[starts[i + s] : ends[i + e - 1]].decode() for s, e in _runs(~cut[i:j]))
            columns = batch.columns
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return C.mapped(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(C.read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) - 18 AS BIGINT))) AS i FROM w WHERE len(ws) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM dup)),
words AS (SELECT doc_id, unnest(range(1, CAST(len(ws) + 1 AS BIGINT))) AS p, unnest(ws) AS word FROM w),
kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL), '') AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
