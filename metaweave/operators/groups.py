"""Null distributions by the degrees of both ends, and the rows of results that they judge."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.functions import significance
from metaweave.operators import cells
from metaweave.operators import relation as R
from metaweave.operators.network import BROADCAST_NODES, Network, Pathlike
from metaweave.plans.schema import Metapath


def end_degrees(network: Network, metapath: Pathlike) -> tuple[DataFrame, DataFrame]:
    """(id, degree) of every source node along the first metaedge and of every target node along the last; 0 for nodes without edges."""
    path = network.schema.metapath(metapath)

    def of(metanode: str, edges: DataFrame, side: str) -> DataFrame:
        found = R.degrees(edges, side)
        nodes = network.nodes[metanode].select("id")
        return nodes.join(found, nodes["id"] == found["node"], "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    return of(path.source, network.edges(path.steps[0]), "src"), of(path.target, network.edges(path.steps[-1]), "dst")


def nodes_by_degree(network: Network, metapath: Pathlike) -> tuple[DataFrame, DataFrame]:
    """(degree, id) of source and target nodes, those of one degree next to each other: rows instead of a list for each degree, which could be most nodes."""
    return tuple(side.repartition("degree").sortWithinPartitions("degree", "id").select("degree", "id") for side in end_degrees(network, metapath))


def mean_of_cells(network: Network, metapath: Pathlike, counts: DataFrame) -> float | None:
    """Mean of v over all pairs of nodes, those without paths too; None if no pair has paths."""
    path = network.schema.metapath(metapath)
    total = counts.agg(F.sum("v")).first()[0]
    return total / (network.count_nodes(path.source) * network.count_nodes(path.target)) if total else None


def degree_groups(network: Network, metapath: Pathlike, counts: DataFrame, scaler: float | None = None) -> DataFrame:
    """(source_degree, target_degree, n, nnz, sum, sum_of_squares) of a metric for every pair of degrees that nodes have.

    scaler: values are asinh(v / scaler); as they are if None. n counts all pairs of nodes and nnz
    those with paths. Pairs without paths are never made: n is the product of two histograms, whose
    size is the number of different degrees.
    """
    source, target = end_degrees(network, metapath)
    value = F.col("v") if scaler is None else F.asinh(F.col("v") / F.lit(float(scaler)))
    s = source.withColumnsRenamed({"id": "src", "degree": "source_degree"})
    t = target.withColumnsRenamed({"id": "dst", "degree": "target_degree"})
    cells = counts.join(s, "src").join(t, "dst").withColumn("value", value)
    found = cells.groupBy("source_degree", "target_degree").agg(
        F.count_if(F.col("value") != 0).alias("nnz"), F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_of_squares")
    )
    rows = s.groupBy("source_degree").agg(F.count("*").alias("a"))
    columns = t.groupBy("target_degree").agg(F.count("*").alias("b"))
    every = rows.crossJoin(columns).select("source_degree", "target_degree", (F.col("a") * F.col("b")).alias("n"))
    zero = F.lit(0.0)
    return every.join(found, ["source_degree", "target_degree"], "left").select(
        "source_degree", "target_degree", "n", F.coalesce("nnz", F.lit(0).cast("long")).alias("nnz"),
        F.coalesce("sum", zero).alias("sum"), F.coalesce("sum_of_squares", zero).alias("sum_of_squares"),
    )


def permuted_groups(permuted: Iterable[Network], metapath: Pathlike, mean: float, damping: float = 0.5) -> DataFrame:
    """Degree groups summed over permutations, with their number n_perms. mean: of the network as observed."""
    each = [degree_groups(p, metapath, p.dwpc(metapath, damping), mean).withColumn("n_perms", F.lit(1).cast("long")) for p in permuted]
    if not each:
        raise ValueError("no permutation")
    sums = [F.sum(c).alias(c) for c in ("n", "nnz", "sum", "sum_of_squares", "n_perms")]
    return reduce(DataFrame.unionByName, each).groupBy("source_degree", "target_degree").agg(*sums)


def _total(a: DataFrame, b: DataFrame | None, apart: bool) -> DataFrame:
    """(total): the sum of v over the product of a and b (None: a turned round), without its diagonal if apart; the product is not made."""
    if b is None:
        less = F.sum(F.col("v") * F.col("v")) if apart else F.lit(0.0)
        return a.groupBy("dst").agg((F.sum("v") * F.sum("v") - less).alias("v")).agg(F.sum("v").alias("total"))
    left, right = (r.groupBy(F.col(side).alias("mid")).agg(F.sum("v").alias(name)) for r, side, name in ((a, "dst", "x"), (b, "src", "y")))
    sums = left.join(right, "mid").select((F.col("x") * F.col("y")).alias("v"))
    return (sums.unionByName(R.hadamard(a, R.transpose(b)).select((-F.col("v")).alias("v"))) if apart else sums).agg(F.sum("v").alias("total"))


def _every_pair(network: Network, path: Metapath, factors: tuple | None, counts: DataFrame | None, one_way: bool) -> DataFrame:
    """(src, dst, n, v) of every pair of nodes, 0 where there is no path."""
    nodes = [network.nodes[m].select("id") for m in (path.source, path.target)]
    many = network.node_counts([path.source, path.target])
    few = many[0] <= BROADCAST_NODES, many[1] <= BROADCAST_NODES
    if factors is None:  # the counts as they are, times the targets
        if one_way:
            counts = counts.where("src <= dst")
        same = nodes[1].select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("v"))
        rows = cells.every_pair(counts, same, *nodes, cells.blocks_of(*many, (network.rows_about(path), many[1])), few, False, False)
        return rows.where("src <= dst") if one_way else rows
    a, b, apart = factors
    rows = network.rows_about(path[:1]), network.rows_about(path[1:])
    blocks = cells.blocks_of(*many, rows)
    if b is None and one_way:
        return cells.every_pair(a, a, *nodes, (max(blocks),) * 2, few, True, apart)
    rows = cells.every_pair(a, R.transpose(a) if b is None else b, *nodes, blocks, few, False, apart)
    return rows.where("src <= dst") if one_way else rows


def pairs(network: Network, metapath: Pathlike, damping: float = 0.5, ignore_zeros: bool = False, ignore_redundant: bool = True) -> DataFrame:
    """A row for each pair: source_id, target_id, source_name, target_name, source_degree, target_degree, path_count, dwpc = asinh(dwpc / mean).

    ignore_zeros leaves out pairs without paths; only with it the size of the result is that of the
    metric, as all pairs of nodes are asked for otherwise. ignore_redundant keeps one direction of
    each pair of a symmetric metapath. Where no pair has paths dwpc is 0.
    """
    path = network.schema.metapath(metapath)
    one_way = ignore_redundant and path.is_symmetric
    factors = None if ignore_zeros else network.two_factors(path, damping)
    counts = network.dwpc(path, damping) if factors is None else None
    total = counts.agg(F.sum("v").alias("total")) if factors is None else _total(*factors)
    # the mean is a row joined to every pair: nothing runs before the result is asked for
    for side in (path.source, path.target):
        total = total.crossJoin(network.nodes[side].agg(F.count("*").alias(f"n{len(total.columns)}")))
    mean = total.select(F.coalesce(F.nullif(F.col("total"), F.lit(0.0)) / (F.col("n1") * F.col("n2")), F.lit(1.0)).alias("mean"))
    source, target = end_degrees(network, path)
    names = ("id", "name")
    s = network.nodes[path.source].select(*names).join(source, "id").select(
        F.col("id").alias("src"), F.col("name").alias("source_name"), F.col("degree").alias("source_degree"))
    t = network.nodes[path.target].select(*names).join(target, "id").select(
        F.col("id").alias("dst"), F.col("name").alias("target_name"), F.col("degree").alias("target_degree"))
    if ignore_zeros:
        scaled = counts.crossJoin(F.broadcast(mean)).select("src", "dst", F.col("n").alias("path_count"), F.asinh(F.col("v") / F.col("mean")).alias("dwpc"))
        rows = (scaled.where("src <= dst") if one_way else scaled).where("dwpc <> 0").join(s, "src").join(t, "dst")
    else:
        every = _every_pair(network, path, factors, counts, one_way).crossJoin(F.broadcast(mean)).select(
            "src", "dst", F.col("n").alias("path_count"), F.when(F.col("n") == 0, 0.0).otherwise(F.asinh(F.col("v") / F.col("mean"))).alias("dwpc"))
        few = [n <= BROADCAST_NODES for n in network.node_counts([path.source, path.target])]
        rows = every.join(F.broadcast(s) if few[0] else s, "src").join(F.broadcast(t) if few[1] else t, "dst")
    return rows.select(
        F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "source_name", "target_name", "source_degree", "target_degree",
        F.coalesce("path_count", F.lit(0).cast("long")).alias("path_count"), F.coalesce("dwpc", F.lit(0.0)).alias("dwpc"),
    )


def significance_of(network: Network, metapath: Pathlike, groups: DataFrame, damping: float = 0.5, ignore_zeros: bool = False, max_p_value: float = 1.0) -> DataFrame:
    """Pairs with the null distribution of their degrees and p_value; rows above max_p_value go, those without a p-value stay.

    A pair whose degrees the groups lack raises an error when the row is computed.
    """
    left = pairs(network, metapath, damping, ignore_zeros).alias("l")
    right = significance.add_gamma_hurdle(groups)
    extra = [c for c in right.columns if c not in ("source_degree", "target_degree")]
    joined = left.join(right.withColumn("_known", F.lit(True)), ["source_degree", "target_degree"], "left")
    gone = F.concat(F.lit("no degree group "), F.col("source_degree").cast("string"), F.lit(", "), F.col("target_degree").cast("string"))
    joined = joined.withColumn("n", F.when(F.col("_known"), F.col("n")).otherwise(F.raise_error(gone).cast("long"))).drop("_known")
    rows = significance.with_p_value(joined)
    order = ["source_id", "target_id", "source_name", "target_name", "source_degree", "target_degree", "path_count", "dwpc"]
    rows = rows.select(*order, *extra, "p_value").drop("sum", "sum_of_squares", "beta", "alpha")
    return rows.where(F.isnull("p_value") | (F.col("p_value") <= max_p_value))
