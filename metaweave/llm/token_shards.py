"""Training-order materialisation: token sequences at keyed-permuted global slots, in fixed-stride binary shards.

Every text is encoded with a byte-level BPE and followed by an end-of-text id; the ids (uint16) of a scan partition's
texts, one after the other, are cut into sequences of `SEQ_LEN`, the partition's last one padded with
`PAD`. The N sequences of the corpus are numbered by partition and place; a keyed Feistel permutation with
cycle-walking on 0..N-1 gives each its global slot, and slot ranges of `PER_SHARD` sequences make
the shards. A shard is one file of records of the same length: the record of slot s is at byte
(s mod PER_SHARD) * stride of file s div PER_SHARD. Reading is sequential, and resuming needs only the next slot.

Texts are encoded once and never shuffled; sequences go to the shared folder and through one shuffle, compressed. Each shard is
written under a temporary name and renamed, so repeated tasks are harmless; a task holds one shard's
records at a time (PER_SHARD * stride bytes, 8 MB). The driver collects a count per scan partition.

Defined cases: a null or empty text gives no ids; repeated rows are each encoded; an empty table gives no shards
and no rows. Sequences hold ids of several documents; first_doc names the one that a sequence begins in. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.llm import common as C
from metaweave.llm.feistel import Permutation
from metaweave.llm.warc import Store

SEQ_LEN = 2048
PER_SHARD = 2048
MAX_TASKS = 20_000
EOT = 50256
PAD = 65535
KEY = 0x5EED_0F_0DE5

_encoders: dict = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("shards", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def packed(ids: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(ids)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def encode(docs: DataFrame, seq_len: int = SEQ_LEN, ranks: str | None = None) -> DataFrame:
    """The sequences: part (scan partition), place, first_doc, n_tokens and ids, written to the shared folder (Zstandard over whole pages, so that texts alike in a page are stored once)."""
    kept = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def run(batches):
        enc, part, place = encoder(ranks or default_ranks()), C.partition_id(), 0
        rest, starts, owners = np.zeros(0, np.uint16), [], []  # ids not yet given out; where texts start in them

        def table(last: bool):
            nonlocal rest, starts, owners, place
            n = -(-len(rest) // seq_len) if last else len(rest) // seq_len
            at = np.searchsorted(np.array(starts, np.int64), np.arange(n) * seq_len, "right") - 1 if n else []
            ids = [rest[i * seq_len : (i + 1) * seq_len] for i in range(n)]
            rows = [[part] * n, list(range(place, place + n)), [owners[k] for k in at], [len(x) for x in ids], [x.tobytes() for x in ids]]
            place += n
            cut = n * seq_len
            rest = rest[cut:]
            keep = max(0, int(np.searchsorted(np.array(starts, np.int64), cut, "right")) - 1) if starts else 0
            starts, owners = [max(0, s - cut) for s in starts[keep:]], owners[keep:]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["part", "place", "first_doc", "n_tokens", "ids"])

        for batch in batches:
            new, size = [rest], len(rest)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    ids = enc.encode_ordinary(text)
                    ids.append(EOT)
                    starts.append(size)
                    owners.append(doc)
                    new.append(np.array(ids, np.uint16))
                    size += len(ids)
                if size > 4 << 20:
                    rest = np.concatenate(new)
                    yield table(False)
                    new, size = [rest], len(rest)
            rest = np.concatenate(new)
            yield table(False)
        yield table(True)

    return C.written(kept.mapInArrow(C.trimmed(run), "part long, place long, first_doc string, n_tokens long, ids binary"), "token-sequences", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "6"})


def materialise(docs: DataFrame, folder: str, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY, ranks: str | None = None) -> DataFrame:
    """Write the shards below folder; returns a row for each sequence: slot, shard, byte_offset, part, place, first_doc, n_tokens, sha256 (of the record)."""
    spark = docs.sparkSession
    encoded = encode(docs, seq_len, ranks)
    bases, total = [], 0
    for r in sorted(encoded.groupBy("part").count().collect()):
        bases.append((r.part, total))
        total += r["count"]
    base = spark.createDataFrame(bases, "part long, base long")
    shards = -(-total // per_shard)

    def place(batches):
        perm = Permutation(total, key)
        for batch in batches:
            slots = perm.rank(batch.column(0).to_numpy(zero_copy_only=False))
            ids = pa.array([packed(x) for x in batch.column(5).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), *batch.columns[1:5], ids], names=["shard", "slot", *batch.schema.names[1:]])

    numbered = encoded.join(F.broadcast(base), "part").select((F.col("base") + F.col("place")).alias("number"), "part", "place", "first_doc", "n_tokens", "ids")
    dealt = numbered.mapInArrow(C.trimmed(place), "shard long, slot long, part long, place long, first_doc string, n_tokens long, ids binary")
    # ranges of shards of equal length; a task writes its shards one after the other
    tasks = max(1, min(shards, MAX_TASKS))
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard") * tasks / max(1, shards)).cast("int")).sortWithinPartitions("shard", "slot")
    names = ["slot", "shard", "byte_offset", "part", "place", "first_doc", "n_tokens", "sha256"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.string()]

    def store(batches):
        out, at, records = Store(folder), None, []
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["shard"] != at:
                    if records:
                        out.put(f"shard-{at:08d}.bin", b"".join(records))
                    at, records = r["shard"], []
                record = unpacked(r["ids"]).ljust(2 * seq_len, b"\xff")
                records.append(record)
                rows.append((r["slot"], at, r["slot"] % per_shard * 2 * seq_len, r["part"], r["place"], r["first_doc"], r["n_tokens"], hashlib.sha256(record).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names=names)
        if records:
            out.put(f"shard-{at:08d}.bin", b"".join(records))

    rows = C.written(dealt.mapInArrow(C.trimmed(store), "slot long, shard long, byte_offset long, part long, place long, first_doc string, n_tokens long, sha256 string"), "token-shards")
    C.drop(encoded)
    return rows.withColumn("first_doc", F.col("first_doc").cast(docs.schema["doc_id"].dataType))


def read_slots(folder: str, slot: int, n: int, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD) -> np.ndarray:
    """n records from a slot on, read in order; resumes anywhere."""
    store, out = Store(folder), []
    while n > 0:
        k = min(n, per_shard - slot % per_shard)
        with store.fs.open_input_file(os.path.join(store.path, f"shard-{slot // per_shard:08d}.bin")) as f:
            f.seek(slot % per_shard * 2 * seq_len)
            out.append(np.frombuffer(f.read(k * 2 * seq_len), np.uint16).reshape(-1, seq_len))
        slot, n = slot + k, n - k
    return np.concatenate(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(C.read_table(spark, sf_dir, "documents"), C.shared_dir(spark, "token-shards"))
