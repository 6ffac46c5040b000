"""Helpers that the corpus operators share.

Text kernels work on whole Arrow string buffers with numpy: words are found by a byte table and
hashed by prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes that separate words when words are runs of `[^\x20\x09-\x0D]`.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are worked on in chunks of about this many bytes (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 18
#: Kernels are given batches of about this many bytes.
BATCH_BYTES = 8 << 20


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in `spark.checkpoint.dir`, as the session has it. Only where that is unset and everything runs on one
    machine (tests) a temporary folder is used; on a cluster an unset directory is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _fallback:
            _fallback[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="metaweave-")
        root = _fallback[sc.applicationId]
    path = spark._jvm.org.apache.hadoop.fs.Path(root)  # a path without a scheme is one of the cluster's default file system
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    root = root.replace("file:/", "file:///", 1) if not root.startswith("file://") else root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, what runs is given to Python in batches of at most about BATCH_BYTES: an executor holds two of them a task, outside its heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, small: bool = False, **options: str) -> DataFrame:
    """The rows written as Parquet (with the writer's options) to the shared folder and read again: cuts lineage, survives lost executors. small: in small batches."""
    path = shared_dir(df.sparkSession, name)
    with small_batches(df.sparkSession) if small else contextlib.nullcontext():
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the folders of tables made by `written` that nothing reads any more."""
    for table in tables:
        _deleted(table.sparkSession, table._folder)


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Into how many partitions rows are dealt where the number has to be stated."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: memory is kept for the next task, as without this


def trimmed(run):
    """run, after which the worker gives its freed memory back: workers live on idle beside later stages, which need the room."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_BYTES, so that a worker's memory doesn't grow with the number of rows it is given at once."""

    def sliced(batches):
        def pieces():
            for batch in batches:
                step = max(1, int(len(batch) * BATCH_BYTES / max(1, batch.nbytes)))
                for i in range(0, len(batch), step):
                    yield batch.slice(i, step)
                    _release()
        return run(pieces())

    return df.mapInArrow(trimmed(sliced), schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def utf8_length(text: Column) -> Column:
    """Bytes of the text in UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, texts: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, one text at least and `texts` at most."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n, first + texts)
        yield first, last
        first = last


def word_table(separators: bytes | tuple[int, ...]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def find_words(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of all texts, and for each text the index of its first word (one more entry at the end)."""
    n = len(is_word)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    edges = np.zeros(n + 1, bool)
    edges[offsets] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | edges[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | edges[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    up, down = _powers.get(base, (np.zeros(0, U64),) * 2)
    if len(up) < n:
        n = max(n, CHUNK_BYTES * 3 // 2)
        up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if n <= 8 * CHUNK_BYTES:
            _powers[base] = up, down
    return up, down


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def hash_grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words, whatever texts they lie in."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    base = 0xD6E8FEB86659FD93
    up, down = powers(len(words), base)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:m]) * down[:m] + U64(n))


def owners(bounds: np.ndarray) -> np.ndarray:
    """For items counted by bounds (n + 1 entries), which of the n ranges each is in."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


class Scans:
    """The guard of a table that is scanned several times: the first scan of each partition leaves its number of
    rows and a digest of their ids and texts in the shared folder; every later one is compared with it and raises an
    error where they differ, so a table that changed meanwhile never gives wrong results."""

    def __init__(self, spark: SparkSession, name: str):
        self.address = shared_dir(spark, name)

    def check(self, batches, ids: int, text: int, first: bool = False):
        """The batches, which must be all of a partition; ids and text are places of columns."""
        part, rows, sums = partition_id(), 0, [0] * 4
        for batch in batches:
            rows += len(batch)
            for k, at in enumerate((ids, text)):
                column = batch.column(at)
                data, offsets = flat_text(column.cast(pa.large_string(), safe=False))
                sizes = np.diff(offsets)
                if column.null_count:
                    sizes[column.is_null().to_numpy(zero_copy_only=False)] = -1
                sums[2 * k] = zlib.crc32(data, sums[2 * k])
                sums[2 * k + 1] = zlib.crc32(sizes.tobytes(), sums[2 * k + 1])
            yield batch
        mine = " ".join(map(str, (rows, *sums))).encode()
        fs, path = pafs.FileSystem.from_uri(self.address)
        at = f"{path}/scan-{part}"
        if first:
            fs.create_dir(path, recursive=True)
            hidden = f"{path}/.{part}.{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as f:
                f.write(mine)
            fs.move(hidden, at)
            return
        known = b"nothing"
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            with fs.open_input_stream(at) as f:
                known = f.read()
        if known != mine:
            raise RuntimeError(f"partition {part} of a table changed between two scans: rows and digests were {known.decode()}, now {mine.decode()}")


class Sides:
    """Rows that belong to the partitions of a table which is scanned several times.

    The table is one that `stable` made, whose partitions are the same each time, so a row is known by
    its partition and its place there; `Scans` proves it. What the operator finds out about rows between two scans is written to the shared
    folder, sorted by partition and in as many folders as there are tasks; the task that scans a partition again
    reads its rows from its folder by row group statistics: texts are never shuffled.
    """

    ROW_BITS = 40  # row = partition << ROW_BITS | place

    def __init__(self, spark: SparkSession, name: str):
        self.address, self.folders = shared_dir(spark, name), tasks(spark)

    def write(self, rows: DataFrame, distinct: bool = False) -> None:
        """Rows with a column `part`, and others; each once if distinct."""
        rows = rows.withColumn("folder", F.pmod("part", F.lit(self.folders)).cast("int")).repartition(self.folders, "folder")
        rows = rows.distinct() if distinct else rows
        rows.sortWithinPartitions("folder", "part").write.partitionBy("folder").option("parquet.block.size", 4 << 20).parquet(self.address)

    def drop(self, spark: SparkSession) -> None:
        """Deletes the rows, when no scan reads them any more."""
        _deleted(spark, self.address)

    def read(self, part: int, columns: list[str]) -> list[np.ndarray] | None:
        """The columns of a partition's rows; None if it has none."""
        fs, path = pafs.FileSystem.from_uri(f"{self.address}/folder={part % self.folders}")
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        table = pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=columns, filter=pads.field("part") == part)
        return [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in columns] if len(table) else None


def partition_id() -> int:
    return TaskContext.get().partitionId()


def pinned(docs: DataFrame) -> DataFrame:
    """docs over partitions that are planned now, once: a scan planned anew could cut files otherwise, as the split size follows the number of cores there are at the time. Plans name the files' folder (or file)."""
    spark, files = docs.sparkSession, docs.inputFiles()
    rdd = docs._jdf.queryExecution().toRdd()
    if files:
        rdd.setName(os.path.commonpath(files))
    rdd.getNumPartitions()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, docs._jdf.schema(), False), spark)


def _plain(plan) -> bool:
    """Whether a plan gives the same rows in the same order each time: columns and filters of files, without randomness."""
    children = plan.children()
    if plan.nodeName() not in ("Project", "Filter", "LogicalRelation", "SubqueryAlias") or not plan.deterministic():
        return False
    return all(_plain(children.apply(i)) for i in range(children.size()))


def stable(docs: DataFrame) -> DataFrame:
    """docs with the same rows in the same partitions each time it runs: a plain scan of files, or else a written copy, with pinned partitions."""
    if docs.inputFiles() and _plain(docs._jdf.queryExecution().optimizedPlan()):
        return pinned(docs)
    return pinned(written(docs, "stable"))
