"""Networks and their results as Parquet tables in a folder that all executors see, and as TSV."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from metaweave.operators import relation as R
from metaweave.operators.network import Network, Pathlike
from metaweave.plans import shapes
from metaweave.plans.schema import Schema


#: Ids drawn for each range of with_positions.
DRAWN = 20


def _ranges(nodes: DataFrame) -> DataFrame:
    """One row, `_bounds`: the ids that begin the second and later ranges. They are drawn by hash, so that every scan finds the same."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = nodes.select("id").where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(DRAWN * parts)
    ids = [r["id"] for r in drawn.orderBy("id").collect()]
    bounds = [ids[i * len(ids) // parts] for i in range(1, parts)] if ids else []
    return spark.createDataFrame([(bounds,)], StructType([StructField("_bounds", ArrayType(nodes.schema["id"].dataType))]))


def with_positions(nodes: DataFrame) -> DataFrame:
    """nodes with `position` from 0 in order of id. Ranges of ids are sorted apart; only their counts and bounds meet the driver.

    Spark's own ranges won't do: it samples anew in each job, and the counts would be those of other ranges.
    """
    spark = nodes.sparkSession
    part = F.size(F.filter("_bounds", lambda b: b <= F.col("id")))
    ranged = nodes.crossJoin(F.broadcast(_ranges(nodes))).withColumn("_part", part).drop("_bounds")
    counts = dict(sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()))
    before, at = [], 0
    for part, count in counts.items():
        before.append((part, at))
        at += count
    starts = spark.createDataFrame(before, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(starts), "_part").select(
        (F.col("_before") + F.col("_place")).cast("long").alias("position"), *nodes.columns)


def chunked(rows: DataFrame, size: int) -> DataFrame:
    """rows (with id) with `chunk`, the number of their run of `size` rows in order of id."""
    return with_positions(rows).select(F.floor(F.col("position") / size).cast("long").alias("chunk"), *rows.columns)


class Store:
    """A folder: schema.json, nodes/<metanode>, edges/<metaedge>, permutations/<name>/<metaedge>, counts/<metric>-<damping>/<metapath>, groups/…"""

    def __init__(self, spark: SparkSession, address: str):
        self.spark, self.address = spark, address.rstrip("/")

    def _at(self, *parts: str) -> str:
        return "/".join([self.address, *(quote(p, safe="") for p in parts)])

    def _path(self, address: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(address)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, *parts: str) -> bool:
        fs, path = self._path(self._at(*parts) + "/_SUCCESS")
        return fs.exists(path)

    def save(self, network: Network, nodes: bool = True, edges: bool = True) -> None:
        text = self.spark.createDataFrame([(network.schema.to_json().replace("\n", " "),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(self._at("schema"))
        if nodes:
            for m, table in network.nodes.items():
                with_positions(table).write.mode("overwrite").parquet(self._at("nodes", m))
        if edges:
            for name in network.schema.metaedges:
                network.edges(name).write.mode("overwrite").parquet(self._at("edges", name))

    def load(self, permutation: str | None = None) -> Network:
        """The network, or a permutation of it."""
        schema = Schema.from_json(self.spark.read.text(self._at("schema")).first()[0])
        nodes = {m: self.spark.read.parquet(self._at("nodes", m)) for m in schema.metanodes if self.exists("nodes", m)}
        folder = ("permutations", permutation) if permutation else ("edges",)
        edges = {n: self.spark.read.parquet(self._at(*folder, n)) for n in schema.metaedges if self.exists(*folder, n)}
        return Network(self.spark, schema, nodes, edges)

    def save_permutation(self, name: str, network: Network) -> None:
        """Saves the edges of a permutation. One of that name becomes name-backup, in place of an earlier backup, and comes back if the writing fails."""
        fs, path = self._path(self._at("permutations", name))
        _, backup = self._path(self._at("permutations", f"{name}-backup"))
        if fs.exists(path):
            fs.delete(backup, True)
            fs.rename(path, backup)
        try:
            self._write_permutation(name, network)
        except Exception:
            fs.delete(path, True)
            if fs.exists(backup):
                fs.rename(backup, path)
            raise

    def _write_permutation(self, name: str, network: Network) -> None:
        for edge in network.schema.metaedges:
            network.edges(edge).write.mode("overwrite").parquet(self._at("permutations", name, edge))

    def permutations(self) -> dict[str, Network]:
        fs, path = self._path(self._at("permutations"))
        names = sorted(unquote(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []
        return {name: self.load(name) for name in names}

    @staticmethod
    def _setting(metric: str, damping: float) -> str:
        return f"{metric}-{float(damping)}"

    def save_counts(self, metapath, metric: str, damping: float, counts: DataFrame) -> None:
        counts.write.mode("overwrite").parquet(self._at("counts", self._setting(metric, damping), str(metapath)))

    def read_counts(self, network: Network, metapath: Pathlike, metric: str = "dwpc", damping: float = 0.5) -> DataFrame:
        """A saved metric of the metapath or of its inverse; walk and path counts are the same where no metanode repeats."""
        path = network.schema.metapath(metapath)
        either = ("dwpc", "dwwc") if shapes.category(path.metanodes) == "no_repeats" else ()
        tried = []
        for m in dict.fromkeys((metric, *either)):
            for p, turned in ((path, False), (path.inverse, True)):
                place = ("counts", self._setting(m, damping), str(p))
                tried.append("/".join(place))
                if self.exists(*place):
                    found = self.spark.read.parquet(self._at(*place))
                    return R.transpose(found) if turned else found
        raise FileNotFoundError(f"none of {tried} in {self.address}")

    def computed(self, network: Network, metapath: Pathlike, metric: str = "dwpc", damping: float = 0.5) -> DataFrame:
        """The saved metric; computed and saved first where there is none."""
        path = network.schema.metapath(metapath)
        try:
            return self.read_counts(network, path, metric, damping)
        except FileNotFoundError:
            self.save_counts(path, metric, damping, getattr(network, metric)(path, damping))
            return self.read_counts(network, path, metric, damping)

    def save_groups(self, metapath, damping: float, groups: DataFrame) -> None:
        groups.write.mode("overwrite").parquet(self._at("groups", self._setting("dwpc", damping), str(metapath)))

    def read_groups(self, metapath, damping: float) -> DataFrame:
        return self.spark.read.parquet(self._at("groups", self._setting("dwpc", damping), str(metapath)))


def write_tsv(df: DataFrame, address: str, compression: str = "gzip") -> None:
    """A folder of TSV part files, each with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", compression).csv(address)


def read_tsv(spark: SparkSession, address: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(address)


def labelled_edges(network: Network) -> DataFrame:
    """All stored edges with names and their metaedge, ids as strings."""
    from functools import reduce

    each = [
        network.labelled(n).select(F.lit(n).alias("metaedge"), F.col("source_id").cast("string").alias("source_id"),
                                   F.col("target_id").cast("string").alias("target_id"), "source_name", "target_name", "v")
        for n in network.schema.metaedges
    ]
    return reduce(DataFrame.unionByName, each)
