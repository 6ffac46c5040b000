"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. A window is `n`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Each
document is scanned once: rolling hashes of its windows are looked up in the broadcast set, and
each hit is verified word by word before it counts. No shuffle takes place.

The set is broadcast in blocks of at most `block_bytes` of benchmark text (documented bound,
16 MiB). A larger benchmark makes more blocks; a worker then holds one block at a time, so memory
stays bounded and the result is the same.

Defined cases: a null or empty text has no words, no hits and no items. Null item texts have no
windows. A null item_id takes part under the name "null". Items that share an id count once.
Repeated document rows give repeated result rows. Empty tables give empty results (documents) or
no hits (benchmark). Only `doc_id` and `text` (`item_id` and `text`) are read; other columns, with
whatever names, pass through `remove` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm import common as C

N = 13
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of other characters, turns the rest into 0.
_NORMAL = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _NORMAL[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _NORMAL[_b] = _b + 32


def normal_words(text: str | None) -> list[bytes]:
    data = _NORMAL[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
    return data.replace(b"\0", b" ").split()


class GramSet:
    """The windows of some benchmark items, by length and hash."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        self.windows: list[bytes] = []
        self.item_ids: list[str] = []
        seen: dict[bytes, int] = {}
        ids: dict[str, int] = {}
        owners: list[set[int]] = []
        lengths: dict[int, list[int]] = {}
        for item_id, text in items:
            words = normal_words(text)
            if not words:
                continue
            k = ids.setdefault(item_id, len(ids))
            size = min(n, len(words))
            for i in range(len(words) - size + 1):
                window = b" ".join(words[i : i + size])
                w = seen.get(window)
                if w is None:
                    w = seen[window] = len(self.windows)
                    self.windows.append(window)
                    owners.append(set())
                    lengths.setdefault(size, []).append(w)
                owners[w].add(k)
        self.item_ids = list(ids)
        self.items = [sorted(x) for x in owners]
        self.by_length = []
        for size, ws in sorted(lengths.items()):
            # two windows of equal hash stay side by side; the verification tells them apart
            hashes = np.array([self._hash(self.windows[w], size) for w in ws], np.uint64)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            sieve = np.zeros(1 << 20, bool)
            sieve[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_length.append((size, hashes, np.array(ws)[order], sieve))

    @staticmethod
    def _hash(window: bytes, size: int) -> int:
        data = np.frombuffer(window, np.uint8)
        starts, ends, _ = C.find_words(data != 0x20, np.array([0, len(data)]))
        return C.hash_grams(C.hash_words(data, starts, ends), size)[0]

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Verified hits by window length: places of the first word, windows, length."""
        for size, known, which, sieve in self.by_length:
            grams = C.hash_grams(hashes, size)
            at = np.flatnonzero(sieve[(grams >> np.uint64(44)).astype(np.int64)])
            at = at[doc[at] == doc[at + size - 1]] if len(at) else at
            j = np.searchsorted(known, grams[at])
            while len(at):
                ok = (j < len(known)) & (known[np.minimum(j, len(known) - 1)] == grams[at])
                at, j = at[ok], j[ok]
                true = np.fromiter((self._same(data, starts, ends, int(p), size, int(which[k])) for p, k in zip(at, j)), bool, len(at))
                if true.any():
                    yield at[true], which[j[true]], size
                at, j = at[~true], j[~true] + 1  # on to another window of the same hash

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: int, size: int, window: int) -> bool:
        return b" ".join(data[starts[q] : ends[q]].tobytes() for q in range(p, p + size)) == self.windows[window]


class Benchmark:
    """The benchmark as broadcast blocks of bounded size."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES):
        rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text"))
        total = rows.agg(F.sum(C.utf8_length(F.col("text")))).first()[0] or 0
        blocks = max(1, -(-total // block_bytes))
        self.blocks = []
        for k in range(blocks):
            part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
            self.blocks.append(spark.sparkContext.broadcast(GramSet([(r[0], r[1]) for r in part.collect()], n)))

    def scan(self, texts: pa.Array) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
        """For each text: words, hit words, items, and the spans (first and last byte) of hit words."""
        data, offsets = C.flat_text(texts)
        found: list = [None] * len(texts)
        marks: dict[int, list] = {}
        items: dict[int, set[str]] = {}
        for block in self.blocks:
            grams = block.value
            for first, last in C.chunks(offsets):
                part = _NORMAL[data[offsets[first] : offsets[last]]]
                starts, ends, bounds = C.find_words(part != 0, offsets[first : last + 1] - offsets[first])
                doc = C.owners(bounds)
                change = marks.setdefault(first, [np.zeros(len(starts) + 1, np.int32), starts, ends, bounds, last])[0]
                for at, windows, size in grams.hits(part, starts, ends, C.hash_words(part, starts, ends), doc):
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size, -1)
                    for d, w in set(zip(doc[at].tolist(), windows.tolist())):
                        items.setdefault(first + d, set()).update(grams.item_ids[i] for i in grams.items[w])
            if len(self.blocks) > 1:
                block._value = None  # one block in memory at a time
                del block._value
        for first, (change, starts, ends, bounds, last) in marks.items():
            hit = np.cumsum(change[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(hit)])
            for d in range(last - first):
                a, b = int(bounds[d]), int(bounds[d + 1])
                n_hit = int(sums[b] - sums[a])
                spans = []
                if n_hit:
                    h = np.concatenate([[0], hit[a:b].view(np.int8), [0]])
                    base = offsets[first + d] - offsets[first]
                    spans = [(int(starts[a + s] - base), int(ends[a + e - 1] - base)) for s, e in zip(np.flatnonzero(np.diff(h) == 1), np.flatnonzero(np.diff(h) == -1))]
                found[first + d] = (b - a, n_hit, sorted(items.get(first + d, ())), spans)
        return found


def is_contaminated(n_words: int, n_hit: int) -> bool:
    """At least a twentieth of the words are hit."""
    return n_hit > 0 and 20 * n_hit >= n_words


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document its doc_id, n_words, n_hit, items (ids, sorted), spans (bytes from, to) and contaminated."""
    grams = Benchmark(docs.sparkSession, benchmark, n, block_bytes)
    kept = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            found = grams.scan(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.list_(pa.string())),
                    pa.array([[{"from": a, "to": b} for a, b in x[3]] for x in found], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                    pa.array([is_contaminated(x[0], x[1]) for x in found], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"],
            )

    kind = kept.schema["doc_id"].dataType.simpleString()
    return C.mapped(kept, run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<from:long,to:long>>, contaminated boolean")


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns kept, without the contaminated ones (`documents`), or with hit words cut out of every text (`spans`)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    grams = Benchmark(docs.sparkSession, benchmark, n, block_bytes)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = grams.scan(batch.column(at))
            if mode == "documents":
                yield batch.filter(pa.array([not is_contaminated(x[0], x[1]) for x in found], pa.bool_()))
                continue
            texts = [_cut(t, x[3]) if x[1] else t for t, x in zip(batch.column(at).to_pylist(), found)]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return C.mapped(docs, run, docs.schema)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw, out, last = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]]).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS i FROM w, lengths WHERE len(ws) >= n)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit_words h ON w.doc_id = h.doc_id LEFT JOIN hit_items g ON w.doc_id = g.doc_id
"""
