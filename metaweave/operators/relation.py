"""Algebra of relations: DataFrames (src, dst, n, v), a row for each pair with paths.

n counts the paths (exact, BIGINT: a count beyond 2^63 raises an error), v sums their weights. The support of a result is taken from n,
so that rounding left over from subtracting v never makes a pair that has no path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["src", "dst"]


def transpose(r: DataFrame) -> DataFrame:
    return r.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in r.columns if c not in PAIR])


def off_diagonal(r: DataFrame) -> DataFrame:
    return r.where(F.col("src") != F.col("dst"))


def degrees(edges: DataFrame, side: str, name: str = "degree") -> DataFrame:
    """Sum of edge values for each node that has any: (node, degree)."""
    return edges.groupBy(F.col(side).alias("node")).agg(F.sum("v").alias(name))


def _beside(edges: DataFrame, table: DataFrame, side: str, small: bool) -> DataFrame:
    """edges with the columns of a table by node: sent to all executors if it is known to be small, else by a join in which Spark splits hubs."""
    table = table.withColumnRenamed("node", side)
    return edges.join(F.broadcast(table) if small else table, side)


def scale_by(edges: DataFrame, side: str, exponent: float, small: bool = False) -> DataFrame:
    """v times the sum of its row (side src) or column (dst) to the power -exponent; sums of 0 scale to 0. small: the nodes of the side are few enough to be sent to all executors."""
    if exponent == 0:
        return edges
    factor = F.when(F.col("sum") == 0, 0.0).otherwise(F.pow("sum", F.lit(-float(exponent))))
    joined = _beside(edges, degrees(edges, side, "sum"), side, small)
    return joined.select(*[c for c in edges.columns if c != "v"], (F.col("v") * factor).alias("v"))


def degree_weighted(edges: DataFrame, damping: float, small: tuple[bool, bool] = (False, False)) -> DataFrame:
    """Relation of one metaedge: n = 1, v by the degrees of both nodes, both taken from the edges as stored. small: as in scale_by, of sources and targets."""
    if damping == 0:
        return edges.select("src", "dst", F.lit(1).cast("long").alias("n"), F.col("v").cast("double").alias("v"))
    both = edges
    for side, name, few in (("src", "row", small[0]), ("dst", "column", small[1])):
        both = _beside(both, degrees(edges, side, name), side, few)
    product = F.col("row") * F.col("column")
    weight = F.when(product == 0, 0.0).otherwise(F.pow(product, F.lit(-float(damping))))
    return both.select("src", "dst", F.lit(1).cast("long").alias("n"), (F.col("v") * weight).cast("double").alias("v"))


def row_weighted(edges: DataFrame, damping: float) -> DataFrame:
    """As degree_weighted, but for the factor of the column, which a sum over rows may be given later. Edges are dealt out by source once, and lie so in the result."""
    rows = edges.repartition("src")
    if damping:
        row = F.sum("v").over(Window.partitionBy("src"))
        rows = rows.select("src", "dst", (F.col("v") * F.when(row == 0, 0.0).otherwise(F.pow(row, F.lit(-float(damping))))).alias("v"))
    return rows.select("src", "dst", F.lit(1).cast("long").alias("n"), F.col("v").cast("double").alias("v"))


def laid_out(edges: DataFrame, damping: float, by: str, small: bool) -> DataFrame:
    """As degree_weighted, but dealt out by one of the nodes (by: src or dst), and lying so in the result. small: whether the other nodes are few enough to be sent to all executors."""
    other = "src" if by == "dst" else "dst"
    if not damping:
        return edges.repartition(by).select("src", "dst", F.lit(1).cast("long").alias("n"), F.col("v").cast("double").alias("v"))
    if small:
        # no condition is moved below this filter, which lets all rows pass: else edges that are made by a shuffle were made twice, with null nodes and without
        edges = edges.where(F.spark_partition_id() >= 0)
        rows = edges.repartition(by).withColumn("two", F.sum("v").over(Window.partitionBy(by)))
        rows = _beside(rows, degrees(edges, other, "one"), other, True)  # after the shuffle, which it would make larger
    else:
        edges = edges.repartition(other).withColumn("one", F.sum("v").over(Window.partitionBy(other)))
        rows = edges.repartition(by).withColumn("two", F.sum("v").over(Window.partitionBy(by)))
    product = F.col("one") * F.col("two")
    weight = F.when(product == 0, 0.0).otherwise(F.pow(product, F.lit(-float(damping))))
    return rows.select("src", "dst", F.lit(1).cast("long").alias("n"), (F.col("v") * weight).cast("double").alias("v"))


def diffusion_step(edges: DataFrame, row_damping: float = 0, column_damping: float = 0, small: tuple[bool, bool] = (False, False)) -> DataFrame:
    """Columns are normalised first; then rows, by the sums that they have after it. small: as in degree_weighted."""
    return scale_by(scale_by(edges.withColumn("v", F.col("v").cast("double")), "dst", column_damping, small[1]), "src", row_damping, small[0])


def _summed(rows: DataFrame, n: Column, v: Column) -> DataFrame:
    return rows.groupBy(*PAIR).agg(F.sum(n).alias("n"), F.sum(v).alias("v"))


def compose(a: DataFrame, b: DataFrame, hub_rows: int | None = None) -> DataFrame:
    """Matrix product.

    A middle node with i rows in a and j in b makes i * j rows. Spark splits partitions by the bytes that go in, not by the rows that come out; with
    hub_rows nodes that make more than these are split by the source node into as many parts, over which b's rows are repeated. Sums
    of pairs begin in each part.
    """
    on = ["mid"]
    left, right = (r.select(F.col(side).alias("mid"), *[c for c in r.columns if c != side]) for r, side in ((a, "dst"), (b, "src")))
    if hub_rows is not None:
        made = left.groupBy("mid").agg(F.count("*").alias("i")).join(right.groupBy("mid").agg(F.count("*").alias("j")), "mid")
        hubs = made.select("mid", F.ceil(F.col("i") * F.col("j") / hub_rows).cast("int").alias("parts")).where("parts > 1")
        parts = F.coalesce("parts", F.lit(1))
        left = left.join(hubs, "mid", "left").withColumn("part", F.pmod(F.xxhash64("src"), parts).cast("int")).drop("parts")
        right = right.join(hubs, "mid", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        on = ["mid", "part"]
    left, right = left.alias("a"), right.alias("b")
    rows = left.join(right, on).select("src", "dst", (F.col("a.n") * F.col("b.n")).alias("n"), (F.col("a.v") * F.col("b.v")).alias("v"))
    return _summed(rows, F.col("n"), F.col("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product cell by cell."""
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") == F.col("b.dst"))
    return a.join(b, same).select("a.src", "a.dst", (F.col("a.n") * F.col("b.n")).alias("n"), (F.col("a.v") * F.col("b.v")).alias("v"))


def closed_walks(a: DataFrame, b: DataFrame) -> DataFrame:
    """The diagonal of the product of a and b as (src, dst = src, n, v), without the product."""
    both = hadamard(a, transpose(b))
    return both.groupBy("src").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).select("src", F.col("src").alias("dst"), "n", "v")


def squared_walks(a: DataFrame) -> DataFrame:
    """closed_walks of a and its transpose."""
    sums = a.groupBy("src").agg(F.sum(F.col("n") * F.col("n")).alias("n"), F.sum(F.col("v") * F.col("v")).alias("v"))
    return sums.select("src", F.col("src").alias("dst"), "n", "v")


def signed_sum(*terms: tuple[int, DataFrame]) -> DataFrame:
    """Sum of relations with signs. Pairs of which n is 0 stay, as v may not be: for what is multiplied further."""
    signed = [r.select("src", "dst", (F.lit(sign) * F.col("n")).alias("n"), (F.lit(float(sign)) * F.col("v")).alias("v")) for sign, r in terms]
    return _summed(reduce(DataFrame.unionByName, signed), F.col("n"), F.col("v"))


def combine(*terms: tuple[int, DataFrame]) -> DataFrame:
    """Sum of relations with signs; pairs without paths go."""
    return signed_sum(*terms).where("n <> 0")


def validate(edges: DataFrame) -> DataFrame:
    """The edges, if there are any and all have nodes and finite values; else ValueError. Runs one aggregate."""
    v = F.col("v").cast("double")
    bad = F.isnull("src") | F.isnull("dst") | F.isnull(v) | F.isnan(v) | (F.abs(v) == float("inf"))
    row = edges.agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad")).first()
    if row["rows"] == 0:
        raise ValueError("no edges")
    if row["bad"]:
        raise ValueError(f"{row['bad']} edges with null nodes or values that are null or not finite")
    return edges


def largest(r: DataFrame, value: str = "n") -> DataFrame:
    """The cell of the largest value (one row; none if there are no cells); of equal ones the first by src and dst."""
    return r.orderBy(F.desc(value), "src", "dst").limit(1)
