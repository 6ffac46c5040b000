"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record is hashed (doc_id and the text's CRC) to one of `SLOTS` virtual slots, bytes and rows
are aggregated per slot, and a small map gives each slot its shard. Version 0 deals the slots out
evenly; rebalancing writes a new version that moves only the slots it must: overloaded shards give
slots up, the lightest shards take them, and single moves then even out what is left. Law: `bytes`.

The slot table has a fixed size, whatever the input (SLOTS rows, and SALTS more for each slot that
alone holds over an eighth of a shard, of which there are 8 * shards at most), so collecting and
broadcasting it is bounded. A slot that heavy (one doc_id on very many rows) is split by salt. Texts are
read once and never shuffled; only (doc_id, size, crc, slot) rows are.

Defined cases: a null text has size 8 and the CRC of the empty text; null doc_ids are hashed as
such; repeated rows each get a place of their own; empty tables give no rows. Ties in a slot are put
in order by doc_id, CRC and size; of rows that agree in all three, either may come first. Equal texts under other ids lie in other slots: their number
doesn't matter to the law. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metaweave.llm import common as C

SLOTS = 4096
SALTS = 64
OVERHEAD = 8


class SlotMap:
    """slot -> shard, by version. A key is (slot, salt); salt -1 is the whole slot.

    known: where an earlier version has its keys; keys that it lacks have no shard until the next rebalancing, but the salts of a slot start where the slot was.
    """

    def __init__(self, shards: int, sizes: dict[tuple[int, int], int], known: dict[tuple[int, int], int] | None = None, version: int = 0, moves: list[dict] | None = None):
        self.shards, self.sizes, self.version = shards, sizes, version
        keys = sorted(sizes)
        if known is None:
            self.at = {k: i * shards // max(1, len(keys)) for i, k in enumerate(keys)}
        else:
            at = {k: known.get(k, known.get((k[0], -1))) for k in keys}
            self.at = {k: s for k, s in at.items() if s is not None}
        self.moves = moves or []

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for k, s in self.at.items():
            out[s] += self.sizes[k]
        return out

    def _commit(self, at: dict) -> None:
        moved = {k: s for k, s in at.items() if self.at.get(k) != s}
        if not moved and self.moves and self.moves[-1]["shards"] == self.shards:
            return
        self.version += 1
        self.moves.append({"version": self.version, "shards": self.shards, "moved": [[*k, s] for k, s in sorted(moved.items())]})
        self.at = at

    def rebalance(self) -> None:
        """A new version with loads as equal as the slots allow; a slot stays unless its shard is too heavy.

        A key heavier than an even share has a shard to itself, and the others share the rest evenly.
        """
        order = sorted(self.sizes, key=lambda k: (-self.sizes[k], k))
        total, giants = sum(self.sizes.values()), 0
        while giants < min(len(order), self.shards - 1) and self.sizes[order[giants]] * (self.shards - giants) > total:
            total -= self.sizes[order[giants]]
            giants += 1
        target = total / (self.shards - giants)
        loads, at, alone = [0] * self.shards, {}, set()
        for k in order[:giants]:
            free = [s for s in range(self.shards) if s not in alone]
            at[k] = self.at[k] if self.at.get(k) in free else free[0]
            alone.add(at[k])
        open_shards = [s for s in range(self.shards) if s not in alone]
        pool = []
        for k in order[giants:]:
            s = self.at.get(k)
            if s is not None and s not in alone and loads[s] + self.sizes[k] <= target:
                loads[s] += self.sizes[k]
                at[k] = s
            else:
                pool.append(k)
        heap = [(loads[s], s) for s in open_shards]
        heapq.heapify(heap)
        for k in pool:
            load, s = heapq.heappop(heap)
            at[k] = s
            loads[s] = load + self.sizes[k]
            heapq.heappush(heap, (loads[s], s))
        by: list[list] = [[] for _ in range(self.shards)]
        for k, s in at.items():
            by[s].append(k)
        for _ in range(50 * self.shards):
            low = min(open_shards, key=lambda s: (loads[s], s))
            for high in sorted(open_shards, key=lambda s: (-loads[s], s)):
                gap = loads[high] - loads[low]
                fit = max((k for k in by[high] if 0 < self.sizes[k] < gap), key=lambda k: (-abs(gap - 2 * self.sizes[k]), k), default=None)
                if fit is not None:
                    break
            else:
                break
            by[high].remove(fit)
            by[low].append(fit)
            loads[high] -= self.sizes[fit]
            loads[low] += self.sizes[fit]
        self._commit({k: s for s, keys in enumerate(by) for k in keys})

    def grow(self, shards: int) -> None:
        """A new version for more shards: the new ones take whole slots from the others, nothing moves between old shards."""
        target = sum(self.sizes.values()) / shards
        loads, at = self.loads() + [0] * (shards - self.shards), dict(self.at)
        new = range(self.shards, shards)
        for k in sorted(at, key=lambda k: (-self.sizes[k], k)):
            to = min(new, key=lambda s: (loads[s], s))
            if loads[at[k]] - self.sizes[k] >= target and loads[to] + self.sizes[k] <= target:
                loads[at[k]] -= self.sizes[k]
                loads[to] += self.sizes[k]
                at[k] = to
        self.shards = shards
        self._commit(at)

    def rows(self) -> list[tuple[int, int, int]]:
        return [(*k, s) for k, s in sorted(self.at.items())]


def save_map(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """The current map as Parquet below path/version=N, and its history of moves as JSON text. A version is written once."""
    rows = spark.createDataFrame(slots.rows(), "slot int, salt int, shard int").withColumn("shards", F.lit(slots.shards))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slots.version}")
    spark.createDataFrame([(json.dumps(m),) for m in slots.moves], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/history-{slots.version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a stored map, those written in full."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    whole = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(v for v in found if fs.exists(whole(f"{path}/version={v}/_SUCCESS")) and fs.exists(whole(f"{path}/history-{v}/_SUCCESS")))


def load_map(spark: SparkSession, path: str, sizes: dict[tuple[int, int], int], version: int | None = None) -> SlotMap:
    """A stored map (its last version), with the sizes of now."""
    version = versions(spark, path)[-1] if version is None else version
    rows = spark.read.parquet(f"{path}/version={version}").collect()  # SLOTS rows and a bounded number of salts
    moves = [json.loads(r[0]) for r in spark.read.text(f"{path}/history-{version}").collect()]
    shards = rows[0].shards if rows else moves[-1]["shards"] if moves else 1
    return SlotMap(shards, sizes, {(r.slot, r.salt): r.shard for r in rows}, version, sorted(moves, key=lambda m: m["version"]))


def _salted(base: DataFrame, hot: list[int]) -> DataFrame:
    """The rows of hot slots with salts: equal rows are numbered and dealt out in turn, others by their hash, so a rerun gives the same. No slot is gathered in one task."""
    key = F.xxhash64("doc_id", "crc", "size").alias("key")
    rows = base.where(F.col("vslot").isin(hot)).select("*", key, F.spark_partition_id().alias("part"))
    rows = C.written(rows.withColumn("nth", F.row_number().over(W.partitionBy("key", "part").orderBy("vslot"))), "hot-slots")
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = counts.select("key", "part", (F.sum("n").over(W.partitionBy("key").orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, ["key", "part"]).select(*base.columns, F.pmod(F.col("key") + F.col("before") + F.col("nth"), F.lit(SALTS)).cast("int").alias("unit"))


def assign(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (its place in the shard, gapless from 0), grown_shard, virtual_slot.

    map_path: a folder with the map; its last version is edited, as a new version, if shards were added or loads changed. Without one a new map is made.
    """
    spark = docs.sparkSession
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    base = C.written(
        docs.select("doc_id", (C.utf8_length(F.col("text")) + OVERHEAD).alias("size"), crc.alias("crc")).select("doc_id", "size", "crc", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(slots)).cast("int").alias("vslot")),
        "sharding",
    )
    totals = base.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    limit = sum(r.bytes for r in totals) / (8 * shards)
    hot = sorted(r.vslot for r in totals if r.bytes > limit and r.n > 1)
    counts = {(r.vslot, -1): (r.bytes, r.n) for r in totals if r.vslot not in set(hot)}
    if hot:
        salted = _salted(base, hot)
        for r in salted.groupBy("vslot", "unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
            counts[r.vslot, r.unit] = (r.bytes, r.n)
        base = base.where(~F.col("vslot").isin(hot)).withColumn("unit", F.lit(-1)).unionByName(salted)
    else:
        base = base.withColumn("unit", F.lit(-1))
    sizes = {k: b for k, (b, _) in counts.items()}
    path = map_path or C.shared_dir(spark, "slot-map")
    if versions(spark, path):
        table = load_map(spark, path, sizes)
        if table.shards > shards:
            raise ValueError(f"the map at {path} has {table.shards} shards: records can't go back to {shards}")
        if table.shards < shards:
            table.grow(shards)
            save_map(spark, table, path)
    else:
        table = SlotMap(shards, sizes)
        save_map(spark, table, path)
    before = table.version
    table.rebalance()
    if table.version > before:
        save_map(spark, table, path)
    filled, placed = [0] * shards, []
    for slot, salt, shard in table.rows():
        placed.append((slot, salt, shard, filled[shard]))
        filled[shard] += counts[slot, salt][1]
    small = spark.createDataFrame(placed, "vslot int, unit int, shard int, first long")
    order = W.partitionBy("vslot", "unit").orderBy("doc_id", "crc", "size")
    return (
        base.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(small), ["vslot", "unit"])
        .select(
            "doc_id",
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("vslot").alias("virtual_slot"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(C.read_table(spark, sf_dir, "documents"))
