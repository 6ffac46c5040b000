"""Named queries over the star-schema tables, which are read as a network, and their SQL."""

from __future__ import annotations

import functools
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.functions import significance
from metaweave.operators import groups, permutation
from metaweave.operators import relation as R
from metaweave.operators.network import Network
from metaweave.plans import shapes
from metaweave.plans.schema import Schema
from metaweave.runtime import settled
from metaweave.sources import store

SCHEMA = Schema(
    {"U": "user", "T": "event type", "H": "hour", "R": "region", "N": "nation", "C": "customer", "O": "order", "P": "part", "S": "supplier", "B": "brand", "Y": "type", "M": "segment"},
    [
        ("N", "i", "R", "both"), ("C", "i", "N", "both"), ("S", "i", "N", "both"), ("C", "g", "M", "both"), ("P", "m", "B", "both"),
        ("P", "k", "Y", "both"), ("C", "p", "O", "both"), ("O", "c", "P", "both"), ("O", "f", "S", "both"), ("S", "s", "P", "both"), ("N", "n", "N", "both"),
        ("U", "d", "T", "both"), ("U", "a", "H", "both"), ("T", "b", "H", "both"), ("T", "n", "T", "both"),
    ],
)
#: Of each metaedge the SQL of its (src, dst); Spark and DuckDB read it alike.
EDGES = {
    "NiR": "SELECT DISTINCT n_nationkey AS src, n_regionkey AS dst FROM nation",
    "CiN": "SELECT DISTINCT c_custkey AS src, c_nationkey AS dst FROM customer",
    "SiN": "SELECT DISTINCT s_suppkey AS src, s_nationkey AS dst FROM supplier",
    "CgM": "SELECT DISTINCT c_custkey AS src, c_mktsegment AS dst FROM customer",
    "PmB": "SELECT DISTINCT p_partkey AS src, p_brand AS dst FROM part",
    "PkY": "SELECT DISTINCT p_partkey AS src, p_type AS dst FROM part",
    "CpO": "SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders",
    "OcP": "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem",
    "OfS": "SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem",
    "SsP": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem",
    "NnN": "SELECT DISTINCT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "UdT": "SELECT DISTINCT user_id AS src, event_type AS dst FROM events",
    "UaH": "SELECT DISTINCT user_id AS src, hour(ts) AS dst FROM events",
    "TbH": "SELECT DISTINCT event_type AS src, hour(ts) AS dst FROM events",
    "TnT": "SELECT DISTINCT a.event_type AS src, b.event_type AS dst FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type",
}
NODES = {
    "R": "SELECT r_regionkey AS id, r_name AS name FROM region", "N": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "C": "SELECT c_custkey AS id, c_name AS name FROM customer", "O": "SELECT o_orderkey AS id, CAST(o_orderkey AS STRING) AS name FROM orders",
    "P": "SELECT p_partkey AS id, p_name AS name FROM part", "S": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "B": "SELECT DISTINCT p_brand AS id, p_brand AS name FROM part", "Y": "SELECT DISTINCT p_type AS id, p_type AS name FROM part",
    "M": "SELECT DISTINCT c_mktsegment AS id, c_mktsegment AS name FROM customer",
    "U": "SELECT DISTINCT user_id AS id, CAST(user_id AS STRING) AS name FROM events", "T": "SELECT DISTINCT event_type AS id, event_type AS name FROM events",
    "H": "SELECT DISTINCT hour(ts) AS id, CAST(hour(ts) AS STRING) AS name FROM events",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class _Deferred(Mapping):
    """Tables that are read when they are first asked for."""

    def __init__(self, names, make):
        self._names, self._make = list(names), functools.cache(make)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        return self._make(name)

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def network(spark: SparkSession, sf_dir: str) -> Network:
    tables = _Deferred(TABLES, lambda t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")))

    def frame(query: str) -> DataFrame:
        used = [t for t in TABLES if t in query.split()]
        for t in used:
            query = query.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        return spark.sql(query, **{t: tables[t] for t in used})

    edges = _Deferred(EDGES, lambda name: frame(EDGES[name]).withColumn("v", F.lit(1.0)))
    return Network(spark, SCHEMA, _Deferred(NODES, lambda m: frame(NODES[m])), edges)


def _edge_sql(step) -> str:
    columns = "src, dst" if step.forward else "dst AS src, src AS dst"
    return f"SELECT {columns} FROM ({EDGES[step.stored]})"


def _weighted_sql(step, damping: float) -> str:
    return (f"SELECT src, dst, pow(count(*) OVER (PARTITION BY src), {-damping}) * pow(count(*) OVER (PARTITION BY dst), {-damping}) AS v FROM ({_edge_sql(step)})")


def paths_sql(metapath: str, damping: float, distinct: bool) -> str:
    """(src, dst, n, v) by a join of all edges, with nodes of a metanode distinct if asked; prefixes are summed as soon as they agree."""
    path = SCHEMA.metapath(metapath)
    nodes = path.metanodes
    ctes = [f"e{i} AS MATERIALIZED ({_weighted_sql(s, damping)})" for i, s in enumerate(path.steps)]
    loop = " WHERE src <> dst" if distinct and nodes[0] == nodes[1] else ""
    ctes.append(f"p0 AS (SELECT src AS x0, dst AS x1, 1 AS n, v FROM e0{loop})")
    kept = [0, 1]
    for i in range(1, len(path)):
        where = " AND ".join(["TRUE"] + [f"p.x{j} <> e.dst" for j in kept if distinct and nodes[j] == nodes[i + 1]])
        keep = [j for j in kept if j == 0 or (distinct and nodes[j] in nodes[i + 2 :])]
        columns = ", ".join(f"p.x{j}" for j in keep)
        ctes.append(f"p{i} AS (SELECT {columns}, e.dst AS x{i + 1}, sum(p.n) AS n, sum(p.v * e.v) AS v FROM p{i - 1} p JOIN e{i} e ON p.x{i} = e.src WHERE {where} GROUP BY {columns}, e.dst)")
        kept = [*keep, i + 1]
    last = len(path) - 1
    return f"WITH {', '.join(ctes)} SELECT x0 AS src, x{last + 1} AS dst, CAST(n AS BIGINT) AS n, v FROM p{last}"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) + F.lit(0.0) for c in columns})


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _counts(name: str, metric: str, metapath: str, damping: float = 0.5, **how) -> None:
    sql = paths_sql(metapath, damping, metric == "dwpc")
    _register(name, lambda spark, sf: _rounded(getattr(network(spark, sf), metric)(metapath, damping, **how), "v"),
              f"SELECT src, dst, n, round(v, 8) + 0.0 AS v FROM ({sql})")


_counts("wc_CpOcPmB", "dwwc", "CpOcPmB", 0.0)
_counts("dwwc_CpOcPmB", "dwwc", "CpOcPmB")
for _order in ("sequential", "recursive", "chain"):
    _counts(f"dwwc_{_order}_MgCpOcPkY", "dwwc", "MgCpOcPkY", order=_order)
for _name, _path in {
    "short_PcOcP": "PcOcP", "short_NnNnN": "NnNnN", "four_NnNnNnN": "NnNnNnN", "long_NnNnNnNnN": "NnNnNnNnN", "disjoint_NnNiSsPsS": "NnNiSsPsS",
    "nested_MgCpOcPcOpCgM": "MgCpOcPcOpCgM", "baba_CpOcPcOcPmB": "CpOcPcOcPmB",
    "around_UdTbHbTbHaU": "UdTbHbTbHaU", "groups_TnTdUaHaUaH": "TnTdUaHaUaH", "interior_UaHaUdTnTbH": "UaHaUdTnTbH", "other_UdTbHaUdTbH": "UdTbHaUdTbH",
}.items():
    _counts(f"dwpc_{_name}", "dwpc", _path)
_counts("pc_NnNnNnN", "dwpc", "NnNnNnN", 0.0)

_register("degree_weighted_edges", lambda spark, sf: _rounded(network(spark, sf).weighted(SCHEMA.step("OcP"), 0.5).drop("n"), "v"),
          f"SELECT src, dst, round(v, 8) + 0.0 AS v FROM ({_weighted_sql(SCHEMA.step('OcP'), 0.5)})")
_register("transpose_edges", lambda spark, sf: network(spark, sf).edges("PcO"), f"SELECT src, dst, 1.0::DOUBLE AS v FROM ({_edge_sql(SCHEMA.step('PcO'))})")


def _degrees_sql(metanode: str, edge: str, side: str, name: str) -> str:
    return (f"SELECT id, count(e.{side}) AS {name} FROM ({NODES[metanode]}) n LEFT JOIN ({_edge_sql(SCHEMA.step(edge))}) e ON n.id = e.{side} GROUP BY id")


_register("degree_source", lambda spark, sf: groups.end_degrees(network(spark, sf), "CpOcP")[0], _degrees_sql("C", "CpO", "src", "degree"))
_register("degree_target", lambda spark, sf: groups.end_degrees(network(spark, sf), "CpOcP")[1], _degrees_sql("P", "OcP", "dst", "degree"))


def _hadamard(spark: SparkSession, sf: str) -> DataFrame:
    n = network(spark, sf)
    return _rounded(R.hadamard(n.dwwc("SfOcP"), n.weighted(SCHEMA.step("SsP"), 0.5)), "v")


_register("hadamard", _hadamard, f"SELECT a.src, a.dst, a.n, round(a.v * b.v, 8) + 0.0 AS v FROM ({paths_sql('SfOcP', 0.5, False)}) a JOIN ({_weighted_sql(SCHEMA.step('SsP'), 0.5)}) b ON a.src = b.src AND a.dst = b.dst")


def _closed(spark: SparkSession, sf: str) -> DataFrame:
    n = network(spark, sf)
    return _rounded(R.closed_walks(n.weighted(SCHEMA.step("OcP"), 0.5), n.weighted(SCHEMA.step("PcO"), 0.5)), "v")


_register("closed_walks", _closed, f"SELECT src, dst, n, round(v, 8) + 0.0 AS v FROM ({paths_sql('OcPcO', 0.5, False)}) WHERE src = dst")


def _difference(spark: SparkSession, sf: str) -> DataFrame:
    n = network(spark, sf)
    return _rounded(R.combine((1, n.dwwc("NnNnN")), (-1, n.dwpc("NnNnN"))), "v")


_register("matrix_difference", _difference, f"SELECT a.src, a.dst, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS n, round(a.v - coalesce(b.v, 0), 8) + 0.0 AS v FROM ({paths_sql('NnNnN', 0.5, False)}) a LEFT JOIN ({paths_sql('NnNnN', 0.5, True)}) b ON a.src = b.src AND a.dst = b.dst WHERE a.n <> coalesce(b.n, 0)")


def _step_sql(edge: str, row: float, column: float) -> str:
    first = f"SELECT src, dst, pow(count(*) OVER (PARTITION BY dst), {-column}) AS v FROM ({_edge_sql(SCHEMA.step(edge))})"
    return f"SELECT src, dst, v * pow(sum(v) OVER (PARTITION BY src), {-row}) AS v FROM ({first})"


_register("diffusion_step", lambda spark, sf: _rounded(R.diffusion_step(network(spark, sf).edges("OcP"), 0.5, 0.5), "v"),
          f"SELECT src, dst, round(v, 8) + 0.0 AS v FROM ({_step_sql('OcP', 0.5, 0.5)})")


def _diffuse(spark: SparkSession, sf: str) -> DataFrame:
    n = network(spark, sf)
    weights = n.nodes["C"].select("id", F.lit(1.0).alias("weight"))
    return _rounded(n.diffuse("CpOcP", weights, 0.5, 1), "score")


_register("diffuse_CpOcP", _diffuse, f"""WITH a AS ({_step_sql('CpO', 1, 0.5)}), b AS ({_step_sql('OcP', 1, 0.5)}),
 o AS (SELECT dst AS id, sum(v) AS w FROM a GROUP BY dst), p AS (SELECT b.dst AS id, sum(o.w * b.v) AS w FROM o JOIN b ON o.id = b.src GROUP BY b.dst)
SELECT n.id, round(coalesce(p.w, 0), 8) + 0.0 AS score FROM ({NODES['P']}) n LEFT JOIN p ON n.id = p.id""")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    n = network(spark, sf)
    return _rounded(groups.degree_groups(n, "CpOcPmB", n.dwpc("CpOcPmB")), "sum", "sum_of_squares")


_GROUPS = f"""WITH s AS ({_degrees_sql('C', 'CpO', 'src', 'source_degree')}), t AS ({_degrees_sql('B', 'PmB', 'dst', 'target_degree')}),
 every AS (SELECT source_degree, target_degree, a * b AS n FROM (SELECT source_degree, count(*) AS a FROM s GROUP BY 1), (SELECT target_degree, count(*) AS b FROM t GROUP BY 1)),
 c AS ({paths_sql('CpOcPmB', 0.5, True)}),
 f AS (SELECT source_degree, target_degree, count(*) AS nnz, sum(v) AS sum, sum(v * v) AS sum_of_squares FROM c JOIN s ON c.src = s.id JOIN t ON c.dst = t.id GROUP BY 1, 2)
SELECT every.source_degree, every.target_degree, n, coalesce(nnz, 0) AS nnz, coalesce(sum, 0) AS sum, coalesce(sum_of_squares, 0) AS sum_of_squares FROM every LEFT JOIN f USING (source_degree, target_degree)"""
_register("degree_group_stats", _groups, f"SELECT source_degree, target_degree, n, nnz, round(sum, 8) + 0.0 AS sum, round(sum_of_squares, 8) + 0.0 AS sum_of_squares FROM ({_GROUPS})")


def _hurdle(spark: SparkSession, sf: str) -> DataFrame:
    n = network(spark, sf)
    stats = groups.degree_groups(n, "CpOcPmB", n.dwpc("CpOcPmB"))
    rows = _rounded(significance.add_gamma_hurdle(stats), "mean_nz", "sd_nz")
    return rows.select("source_degree", "target_degree", "nnz", "mean_nz", "sd_nz", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("beta", "alpha")])


_register("gamma_hurdle", _hurdle, f"""WITH g AS ({_GROUPS}),
 m AS (SELECT source_degree, target_degree, nnz, sum / nullif(nnz, 0) AS mean_nz,
  CASE WHEN nnz >= 2 THEN CASE WHEN abs(sum_of_squares - sum * sum / nnz) < 1e-5 THEN 0 ELSE sqrt((sum_of_squares - sum * sum / nnz) / (nnz - 1)) END END AS sd_nz FROM g)
SELECT source_degree, target_degree, nnz, round(mean_nz, 8) + 0.0 AS mean_nz, round(sd_nz, 8) + 0.0 AS sd_nz,
 round(mean_nz / nullif(sd_nz * sd_nz, 0), 4) + 0.0 AS beta, round(mean_nz * mean_nz / nullif(sd_nz * sd_nz, 0), 4) + 0.0 AS alpha FROM m""")


def _pairs(metapath: str, ignore_zeros: bool):
    return lambda spark, sf: _rounded(groups.pairs(network(spark, sf), metapath, 0.5, ignore_zeros), "dwpc")


def _pairs_sql(metapath: str, first: str, last: str, ignore_zeros: bool) -> str:
    path = SCHEMA.metapath(metapath)
    one_way = "s.id <= t.id" if path.is_symmetric else "TRUE"
    shown = "c.n IS NOT NULL" if ignore_zeros else "TRUE"
    return f"""WITH c AS ({paths_sql(metapath, 0.5, True)}), s AS ({_degrees_sql(path.source, first, 'src', 'source_degree')}), t AS ({_degrees_sql(path.target, last, 'dst', 'target_degree')}),
 m AS (SELECT sum(v) / ((SELECT count(*) FROM s) * (SELECT count(*) FROM t)) AS mean FROM c)
SELECT s.id AS source_id, t.id AS target_id, sn.name AS source_name, tn.name AS target_name, source_degree, target_degree, coalesce(c.n, 0) AS path_count, round(coalesce(asinh(c.v / m.mean), 0), 8) + 0.0 AS dwpc
FROM s CROSS JOIN t CROSS JOIN m JOIN ({NODES[path.source]}) sn ON sn.id = s.id JOIN ({NODES[path.target]}) tn ON tn.id = t.id LEFT JOIN c ON c.src = s.id AND c.dst = t.id WHERE {one_way} AND {shown}"""


_register("pairs_CpOcPmB", _pairs("CpOcPmB", False), _pairs_sql("CpOcPmB", "CpO", "PmB", False))
_register("pairs_nonzero_CpOcPmB", _pairs("CpOcPmB", True), _pairs_sql("CpOcPmB", "CpO", "PmB", True))
_register("pairs_symmetric_SsPsS", _pairs("SsPsS", False), _pairs_sql("SsPsS", "SsP", "PsS", False))


#: A null table by degrees of which the gamma distribution has alpha = 4, so that its upper tail has a closed form: exp(-x) (1 + x + x^2/2 + x^3/6), x = 4 dwpc / mean.
#: Some degrees have no permuted path, some a single one (no spread known), some no spread.
_NULL = """SELECT source_degree, target_degree, n, CASE WHEN target_degree % 5 = 0 THEN 0 WHEN target_degree % 5 = 1 THEN 1 ELSE greatest(2, n // 3) END AS nnz,
 1 + source_degree % 4 / 8.0 AS mean_nz, CASE WHEN target_degree % 5 = 2 THEN 0.0 ELSE (1 + source_degree % 4 / 8.0) / 2 END AS sd_nz"""


def _significance(spark: SparkSession, sf: str, max_p_value: float = 1.0) -> DataFrame:
    n = network(spark, sf)
    every = groups.degree_groups(n, "CpOcPmB", n.dwpc("CpOcPmB")).select("source_degree", "target_degree", "n")
    null = spark.sql(_NULL.replace("//", "DIV") + " FROM {every}", every=every)
    mean, sd, count = F.col("mean_nz").cast("double"), F.col("sd_nz").cast("double"), F.col("nnz").cast("double")
    null = null.select("source_degree", "target_degree", "n", F.col("nnz").cast("long").alias("nnz"), (mean * count).alias("sum"),
                       F.when(F.col("nnz") > 1, mean * mean * count + (count - 1) * sd * sd).otherwise(mean * mean * count).alias("sum_of_squares"))
    rows = groups.significance_of(n, "CpOcPmB", null, max_p_value=max_p_value)
    return _rounded(rows, "dwpc", "mean_nz", "sd_nz", "p_value")


def _significance_sql(max_p_value: float) -> str:
    pairs = _pairs_sql("CpOcPmB", "CpO", "PmB", False).replace("round(coalesce(asinh(c.v / m.mean), 0), 8) + 0.0 AS dwpc", "coalesce(asinh(c.v / m.mean), 0) AS dwpc")
    return f"""WITH nl AS (SELECT source_degree, target_degree, n, nnz, CASE WHEN nnz > 0 THEN CAST(mean_nz AS DOUBLE) END AS mean_nz, CASE WHEN nnz > 1 THEN CAST(sd_nz AS DOUBLE) END AS sd_nz
  FROM ({_NULL} FROM ({_GROUPS}))), p AS ({pairs}),
 x AS (SELECT p.*, n, nnz, mean_nz, sd_nz, 4 * dwpc / mean_nz AS x FROM p JOIN nl USING (source_degree, target_degree)),
 q AS (SELECT *, CASE WHEN path_count = 0 THEN 1.0 WHEN nnz = 0 THEN 0.0 WHEN sd_nz > 0 THEN nnz / n * exp(-x) * (1 + x + x * x / 2 + x * x * x / 6) WHEN dwpc <= mean_nz + 1e-5 THEN nnz / n ELSE 0.0 END AS p_value FROM x)
SELECT source_id, target_id, source_name, target_name, source_degree, target_degree, path_count, round(dwpc, 8) + 0.0 AS dwpc, CAST(n AS BIGINT) AS n, CAST(nnz AS BIGINT) AS nnz,
 round(mean_nz, 8) + 0.0 AS mean_nz, round(sd_nz, 8) + 0.0 AS sd_nz, round(p_value, 8) + 0.0 AS p_value FROM q WHERE p_value IS NULL OR p_value <= {max_p_value}"""


_register("p_values_CpOcPmB", _significance, _significance_sql(1.0))
_register("p_values_up_to_CpOcPmB", lambda spark, sf: _significance(spark, sf, 0.05), _significance_sql(0.05))


def _permuted_degrees(spark: SparkSession, sf: str) -> DataFrame:
    edges = permutation.permute(network(spark, sf).edges("OcP"), seed=1)
    return R.degrees(edges, "dst").select(F.col("node").alias("id"), F.col("degree").cast("long").alias("degree"))


_register("permuted_degrees", _permuted_degrees, f"SELECT dst AS id, count(*) AS degree FROM ({EDGES['OcP']}) GROUP BY dst")


def _permuted(spark: SparkSession, sf: str) -> DataFrame:
    """That a permutation changes most edges, keeps both degrees, repeats none and makes none that is excluded: one row."""
    before = network(spark, sf).edges("OcP")
    barred = before.agg(F.min("src").alias("src")).join(before.select("dst").distinct()).select("src", "dst")
    after = settled(permutation.permute(before, excluded=barred, seed=2))
    stats = permutation.permutation_stats(before, after).select("edges", (F.col("share_unchanged") < 0.2).alias("changed"))
    degrees = [R.degrees(e, side).select(F.lit(side).alias("side"), F.col("node"), F.col("degree").cast("long")) for e in (before, after) for side in ("src", "dst")]
    moved = degrees[0].union(degrees[1]).exceptAll(degrees[2].union(degrees[3])).agg((F.count("*") == 0).alias("degrees_kept"))
    once = after.groupBy("src", "dst").count().agg(F.coalesce(F.max("count") == 1, F.lit(True)).alias("edges_once"))
    fresh = after.join(barred, ["src", "dst"], "left_semi").join(before, ["src", "dst"], "left_anti").agg((F.count("*") == 0).alias("none_excluded"))
    return stats.crossJoin(moved).crossJoin(once).crossJoin(fresh)


_register("permuted_edges", _permuted, f"SELECT count(*) AS edges, TRUE AS changed, TRUE AS degrees_kept, TRUE AS edges_once, TRUE AS none_excluded FROM ({EDGES['OcP']})")


def _observed_significance(spark: SparkSession, sf: str) -> DataFrame:
    n = network(spark, sf)
    mean = groups.mean_of_cells(n, "SsPmB", n.dwpc("SsPmB"))
    part = Schema(SCHEMA.metanodes, [("S", "s", "P", "both"), ("P", "m", "B", "both")])
    null = groups.permuted_groups(permutation.permute_network(Network(spark, part, n.nodes, n._edges), 2).values(), "SsPmB", mean)
    return _rounded(groups.significance_of(n, "SsPmB", null, ignore_zeros=True), "dwpc", "mean_nz", "sd_nz", "p_value")


_register("significance_SsPmB", _observed_significance, None)
_register("node_ids", lambda spark, sf: network(spark, sf).node_ids("P"), "SELECT p_partkey AS id FROM part ORDER BY id")
_register("largest_cell", lambda spark, sf: R.largest(network(spark, sf).dwwc("CpOcPmB", 0.0)).select("src", "dst", "n"),
          f"SELECT src, dst, n FROM ({paths_sql('CpOcPmB', 0.0, False)}) ORDER BY n DESC, src, dst LIMIT 1")
_register("node_chunks", lambda spark, sf: store.chunked(network(spark, sf).nodes["C"].select("id"), 400),
          "SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 400 AS chunk, c_custkey AS id FROM customer")
_register("degrees_to_nodes", lambda spark, sf: groups.nodes_by_degree(network(spark, sf), "CpOcPmB")[0],
          f"SELECT degree, id FROM ({_degrees_sql('C', 'CpO', 'src', 'degree')})")
_EVENT_PATHS = ("UdTbHbTbHaU", "TnTdUaHaUaH", "UaHaUdTnTbH", "UdTbHaUdTbH")
_CATALOGUE = ("CpOcPmB", "PcOcP", "NnNnNnN", "NnNnNnNnN", "NnNiSsPsS", "MgCpOcPcOpCgM", "OcPcOcP", "SsPcOcPcOfS")


def _frequency(spark: SparkSession, sf: str) -> DataFrame:
    count = shapes.segment_frequency([SCHEMA.metapath(p) for p in _CATALOGUE])
    return spark.createDataFrame([(str(p), c) for p, c in count.items()], "segment string, frequency long")


_register("categories", lambda spark, sf: spark.createDataFrame([(p, shapes.category(SCHEMA.metapath(p).metanodes)) for p in (*_CATALOGUE, *_EVENT_PATHS)], "metapath string, category string"),
          "SELECT * FROM (VALUES ('UdTbHbTbHaU', 'repeat_around'), ('TnTdUaHaUaH', 'disjoint_groups'), ('UaHaUdTnTbH', 'interior_complete_group'), ('UdTbHaUdTbH', 'other'), ('CpOcPmB', 'no_repeats'), ('PcOcP', 'short_repeat'), ('NnNnNnN', 'four_repeat'), ('NnNnNnNnN', 'long_repeat'), ('NnNiSsPsS', 'disjoint'), ('MgCpOcPcOpCgM', 'BAAB'), ('OcPcOcP', 'BABA'), ('SsPcOcPcOfS', 'repeat_around')) t(metapath, category)")
_register("segment_frequency", _frequency,
          "SELECT segment, CAST(frequency AS BIGINT) AS frequency FROM (VALUES ('CpOcPmB', 1), ('PcOcP', 1), ('NnNnNnN', 1), ('NnN', 4), ('NnNnNnNnN', 1), ('NnNiSsPsS', 1), ('NiS', 1), ('SsPsS', 1), ('MgCpOcPcOpCgM', 1), ('MgC', 2), ('CpO', 2), ('OcPcO', 1), ('OcPcOcP', 2), ('OcP', 6), ('SsPcOcPcOfS', 1), ('SsP', 1), ('OfS', 1)) t(segment, frequency)")
