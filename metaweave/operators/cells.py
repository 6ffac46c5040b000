"""Every pair of two metanodes with its value in a product, pairs without paths too: blocks of sources against blocks of targets.

What is shuffled are the two factors, each packed by block; the cells of a pair of blocks, most of which may be empty, are made where
they are used, so that nothing of the size of all pairs is ever stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Cells of two blocks, nodes and rows of a block, products expanded at once and rows put out at once, about.
CELLS, NODES, ROWS, PRODUCTS, OUT = 1_000_000, 1000, 500_000, 500_000, 250_000


def blocks_of(sources: float, targets: float, rows: tuple[float, float]) -> tuple[int, int]:
    """Numbers of blocks of sources and of targets. rows: of the two factors."""
    across = min(max(1.0, targets), NODES)
    return (math.ceil(max(1.0, sources / (CELLS / across), rows[0] / ROWS)), math.ceil(max(1.0, targets / NODES, rows[1] / ROWS)))


def _packing(block, nodes, rows) -> Iterator:
    """One row for a block: its nodes, the middle nodes in order, and by middle node the places of the ends with n and v."""
    import numpy as np
    import pyarrow as pa

    ids = np.sort(nodes["end"].to_numpy())
    end, mid, n, v = (rows[c].to_numpy() for c in ("end", "mid", "n", "v"))
    at = np.searchsorted(ids, end) if len(ids) else np.zeros(len(end), np.int64)
    known = at < len(ids)
    known[known] = ids[at[known]] == end[known]
    at, mid, n, v = at[known], mid[known], n[known], v[known]
    order = np.argsort(mid, kind="stable")
    mid = mid[order]
    starts = np.flatnonzero(np.concatenate([[True], mid[1:] != mid[:-1]])) if len(mid) else np.zeros(0, np.int64)
    bounds = np.append(starts, len(mid)).astype(np.int32)
    packed = {"bounds": bounds, "at": at[order].astype(np.int32), "n": n[order].astype(np.int64), "v": v[order].astype(np.float64)}
    kinds = nodes.schema.field("end").type, rows.schema.field("mid").type
    yield pa.table({
        "block": pa.array([block[0].as_py()], pa.int32()), "ids": pa.array([pa.array(ids, kinds[0])], pa.list_(kinds[0])), "mids": pa.array([pa.array(mid[starts], kinds[1])], pa.list_(kinds[1])),
        **{k: pa.array([x.tobytes()], pa.binary()) for k, x in packed.items()},
    })


def _packed(r: DataFrame, end: str, mid: str, ids: DataFrame, blocks: int, few: bool) -> DataFrame:
    kinds = dict(ids.dtypes)["id"], dict(r.dtypes)[mid]
    # in order of the ids, which may lie together with what they meet
    nodes = ids.where("id IS NOT NULL").select(F.col("id").alias("end"), (F.ntile(blocks).over(Window.orderBy("id")) - 1).alias("block"))
    beside = nodes.select(F.col("end").alias("known"), F.col("block").alias("of"))
    rows = r.select(F.col(end).cast(kinds[0]).alias("end"), F.col(mid).alias("mid"), "n", "v").where("mid IS NOT NULL")
    rows = rows.join(F.broadcast(beside) if few else beside, F.col("end") == F.col("known")).select("end", "mid", "n", "v", F.col("of").alias("block"))

    def pack(key, left, right):
        return next(_packing(key, left, right))

    schema = f"block int, ids array<{kinds[0]}>, mids array<{kinds[1]}>, bounds binary, at binary, n binary, v binary"
    # the second shuffle lets each pair of blocks read what is packed, instead of packing it again
    return nodes.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(pack, schema).repartition(blocks, "block")


def _cells(a: dict, b: dict):
    """(n, v) of two blocks as matrices."""
    import numpy as np

    shape = len(a["ids"]), len(b["ids"])
    n, v = np.zeros(shape[0] * shape[1], np.int64), np.zeros(shape[0] * shape[1])
    if not len(a["mids"]) or not len(b["mids"]):
        return n.reshape(shape), v.reshape(shape)
    if a["mids"][-1] < b["mids"][0] or b["mids"][-1] < a["mids"][0]:
        return n.reshape(shape), v.reshape(shape)
    place = np.searchsorted(b["mids"], a["mids"])
    place[place == len(b["mids"])] = 0
    common = np.flatnonzero(b["mids"][place] == a["mids"])
    place = place[common]
    first, rows = a["bounds"][common].astype(np.int64), np.diff(a["bounds"])[common]
    other, columns = b["bounds"][place].astype(np.int64), np.diff(b["bounds"])[place]
    # one line for each row of a that meets any of b
    line = np.repeat(np.arange(len(common)), rows)
    left = first[line] + np.arange(len(line)) - (np.cumsum(rows) - rows)[line]
    made = columns[line].astype(np.int64)
    ends = np.cumsum(made)
    most = np.zeros(len(n))
    at = 0
    while at < len(line):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
        some = made[at:stop]
        x = np.repeat(left[at:stop], some)
        y = np.repeat(other[line[at:stop]] - (np.cumsum(some) - some), some) + np.arange(len(x))
        cell = a["at"][x].astype(np.int64) * shape[1] + b["at"][y]
        counts = a["n"][x].astype(float) * b["n"][y]
        most += np.bincount(cell, np.abs(counts), len(most))
        if most.max() < 2.0**52:
            n += np.bincount(cell, counts, len(n)).astype(np.int64)
        elif most.max() < 2.0**62:
            np.add.at(n, cell, a["n"][x] * b["n"][y])
        else:
            raise OverflowError("a count of paths is beyond 64 bits")
        v += np.bincount(cell, a["v"][x] * b["v"][y], len(v))
        at = stop
    return n.reshape(shape), v.reshape(shape)


def every_pair(a: DataFrame, b: DataFrame, sources: DataFrame, targets: DataFrame, blocks: tuple[int, int], few: tuple[bool, bool], mirrored: bool, apart: bool) -> DataFrame:
    """(src, dst, n, v) of the product of a and b for every source with every target (id); n and v are 0 where nothing leads from one to the other.

    few: whether the sources and the targets can be sent to all executors. mirrored: b is a turned round, and of each two pairs only the one with src <= dst is wanted. apart: a node has no path to itself.
    """
    left = _packed(a, "src", "dst", sources, blocks[0], few[0])
    right = left if mirrored else _packed(b, "dst", "src", targets, blocks[1], few[1])
    kinds = dict(sources.dtypes)["id"], dict(targets.dtypes)["id"]
    left, right = (r.select(*[F.col(c).alias(p + c) for c in r.columns]) for r, p in ((left, "a_"), (right, "b_")))
    both = left.join(right, F.col("a_block") <= F.col("b_block")) if mirrored else left.crossJoin(right)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        types = {"at": np.int32, "bounds": np.int32, "n": np.int64, "v": np.float64}

        def side(batch, i, p):
            x = {k: np.frombuffer(batch.column(p + k)[i].as_py(), t) for k, t in types.items()}
            return x | {k: batch.column(p + k)[i].values.to_numpy(zero_copy_only=False) for k in ("ids", "mids")} | {"block": batch.column(p + "block")[i].as_py()}

        for batch in batches:
            kind = [batch.schema.field(p + "ids").type.value_type for p in ("a_", "b_")]
            for i in range(batch.num_rows):
                x, y = side(batch, i, "a_"), side(batch, i, "b_")
                n, v = _cells(x, y)
                step = max(1, OUT // max(1, len(y["ids"])))
                for at in range(0, len(x["ids"]), step):
                    some = x["ids"][at : at + step]
                    src, dst = np.repeat(some, len(y["ids"])), np.tile(y["ids"], len(some))
                    out = [src, dst, n[at : at + step].reshape(-1), v[at : at + step].reshape(-1)]
                    if apart and (x["block"] == y["block"] or not mirrored):
                        kept = src != dst
                        out[2:] = [np.where(kept, c, c.dtype.type(0)) for c in out[2:]]
                    if mirrored and x["block"] == y["block"]:
                        kept = src <= dst
                        out = [c[kept] for c in out]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], kind[0]), pa.array(out[1], kind[1]), pa.array(out[2]), pa.array(out[3])], names=["src", "dst", "n", "v"])

    return both.mapInArrow(run, f"src {kinds[0]}, dst {kinds[1]}, n long, v double")
