"""The product of relations that meet in few nodes: blocks of sources times blocks of targets, each cell summed where it is made.

A join by the middle node would make every product a row, and no more tasks than there are such nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Middle nodes at most, and sources and targets in a block.
MIDDLE, SOURCES, TARGETS = 256, 256, 2048
#: Rows of the right side that are sent to all executors.
BROADCAST_ROWS = 500_000


def _packed(r: DataFrame, end: str, mid: str, blocks: int, prefix: str) -> DataFrame:
    columns = {"e": end, "m": mid, "n": "n", "v": "v"}
    kept = r.select(*[F.col(c).alias(f"{prefix}{k}") for k, c in columns.items()], F.pmod(F.xxhash64(end), F.lit(blocks)).alias("block"))
    return kept.groupBy("block").agg(*[F.collect_list(f"{prefix}{k}").alias(f"{prefix}{k}") for k in columns]).drop("block")


def _whole(a, b):
    """Product of integer matrices, exact; beyond 64 bits an error."""
    import numpy as np

    most = float((np.abs(a).astype(float) @ np.abs(b).astype(float)).max(initial=0.0))
    if most < 2.0**52:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    if most < 2.0**62:
        return a @ b
    exact = a.astype(object) @ b.astype(object)
    if max(map(abs, exact.flat)) >= 1 << 63:
        raise OverflowError("a count of paths is beyond 64 bits")
    return exact.astype(np.int64)


def _multiply(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def coded(column):
        codes = column.dictionary_encode()
        return codes.indices.to_numpy(zero_copy_only=False), codes.dictionary

    for batch in batches:
        for i in range(batch.num_rows):
            x = {name: batch.column(name)[i].values for name in batch.schema.names}
            mid, middle = coded(pa.concat_arrays([x["am"], x["bm"]]))
            row, sources = coded(x["ae"])
            column, targets = coded(x["be"])
            left, right = (row, mid[: len(row)]), (mid[len(row) :], column)
            shapes = (len(sources), len(middle)), (len(middle), len(targets))

            def matrices(kind, values):
                out = []
                for at, shape, v in zip((left, right), shapes, values):
                    m = np.zeros(shape, kind)
                    np.add.at(m, at, v)
                    out.append(m)
                return out

            a, b = matrices(np.float32, (1, 1))
            at = np.nonzero(a @ b)
            n = _whole(*matrices(np.int64, [x[k].to_numpy(zero_copy_only=False) for k in ("an", "bn")]))[at]
            a, b = matrices(np.float64, [x[k].to_numpy(zero_copy_only=False) for k in ("av", "bv")])
            v = (a @ b)[at]
            yield pa.RecordBatch.from_arrays([sources.take(pa.array(at[0])), targets.take(pa.array(at[1])), pa.array(n), pa.array(v)], names=["src", "dst", "n", "v"])


def compose(a: DataFrame, b: DataFrame, sources: float, targets: float, rows: float) -> DataFrame:
    """As relation.compose. sources, targets: numbers of nodes; rows: of b, about."""
    spark = a.sparkSession
    many = math.ceil(max(1, sources) / SOURCES)
    left = _packed(a, "src", "dst", many, "a").repartition(min(many, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    right = _packed(b, "dst", "src", math.ceil(max(1, targets) / TARGETS), "b")
    right = F.broadcast(right) if rows <= BROADCAST_ROWS else right.repartition(8)
    kinds = dict(a.dtypes)["src"], dict(b.dtypes)["dst"]
    return left.crossJoin(right).mapInArrow(_multiply, f"src {kinds[0]}, dst {kinds[1]}, n long, v double")
