"""Matrix files: relations as dense (.npy) or sparse (.sparse.npz) matrices, whose rows and columns are nodes in order of position.

They are read and written on the driver, for exchange of networks that fit there; Parquet is the form for the cluster.
A folder of them holds nodes/<metanode>.tsv (position, identifier, name) and edges/<metaedge>.<ending>.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.operators.network import Network
from metaweave.plans.schema import Schema

#: Endings, in the order in which a folder is searched.
ENDINGS = (".sparse.npz", ".npy")


def read_cells(path: str | Path) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Rows, columns and values of the cells that aren't 0, and the matrix's shape."""
    with np.load(path) if str(path).endswith(".npz") else open(path, "rb") as f:
        if str(path).endswith(".npy"):
            matrix = np.load(f)
            rows, columns = np.nonzero(matrix)
            return rows, columns, matrix[rows, columns], matrix.shape
        kind = f["format"].item()
        kind = kind.decode() if isinstance(kind, bytes) else kind
        shape, values = tuple(int(x) for x in f["shape"]), f["data"]
        if kind == "coo":
            rows, columns = f["row"], f["col"]
        elif kind in ("csr", "csc"):
            major, minor = np.repeat(np.arange(len(f["indptr"]) - 1), np.diff(f["indptr"])), f["indices"]
            rows, columns = (major, minor) if kind == "csr" else (minor, major)
        else:
            raise ValueError(f"{path}: sparse format {kind!r}")
        there = values != 0
        return rows[there], columns[there], values[there], shape


def write_cells(path: str | Path, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> None:
    """A matrix file; the ending tells which kind. Cells are given once."""
    if str(path).endswith(".npy"):
        matrix = np.zeros(shape)
        matrix[rows, columns] = values
        np.save(path, matrix)
    elif str(path).endswith(".npz"):
        order = np.lexsort((columns, rows))
        ends = np.searchsorted(rows[order], np.arange(shape[0] + 1)).astype(np.int32)
        np.savez_compressed(path, indices=columns[order].astype(np.int32), indptr=ends, format=np.array(b"csr"), shape=np.array(shape), data=values[order])
    else:
        raise ValueError(f"{path}: the ending must be one of {ENDINGS}")


def read_relation(spark: SparkSession, path: str | Path, sources: list, targets: list) -> DataFrame:
    """(src, dst, v) of a matrix file; sources and targets are the nodes of its rows and columns."""
    rows, columns, values, shape = read_cells(path)
    if shape != (len(sources), len(targets)):
        raise ValueError(f"{path}: shape {shape}, but {len(sources)} sources and {len(targets)} targets")
    table = pd.DataFrame({"src": np.array(sources, object)[rows], "dst": np.array(targets, object)[columns], "v": values.astype(float)})
    kind = "bigint" if all(isinstance(x, int) for x in [*sources, *targets]) else "string"
    return spark.createDataFrame(table, f"src {kind}, dst {kind}, v double")


def write_relation(relation: DataFrame, path: str | Path, sources: list, targets: list) -> None:
    """The v of a relation as a matrix file. It is collected to the driver."""
    row, column = ({x: i for i, x in enumerate(side)} for side in (sources, targets))
    cells = relation.select("src", "dst", F.col("v").cast("double").alias("v")).toPandas()
    write_cells(path, cells["src"].map(row).to_numpy(np.int64), cells["dst"].map(column).to_numpy(np.int64), cells["v"].to_numpy(), (len(sources), len(targets)))


def _named(folder: Path, name: str) -> Path:
    for ending in ENDINGS:
        if (path := folder / f"{name}{ending}").exists():
            return path
    raise FileNotFoundError(f"no {name} with one of {ENDINGS} in {folder}")


def load_folder(spark: SparkSession, folder: str | Path, schema: Schema) -> Network:
    """The network of a folder; files of nodes are named by metanode (name or abbreviation), of edges by metaedge."""
    folder, ids, nodes = Path(folder), {}, {}
    for short, name in schema.metanodes.items():
        path = next((p for p in (folder / "nodes" / f"{n}.tsv" for n in (name, short)) if p.exists()), None)
        if path is None:
            raise FileNotFoundError(f"no nodes of {name} in {folder}")
        table = pd.read_csv(path, sep="\t", dtype={"identifier": str, "name": str}, keep_default_na=False).sort_values("position")
        ids[short] = table["identifier"].tolist()
        nodes[short] = spark.createDataFrame(table[["identifier", "name"]].rename(columns={"identifier": "id"}), "id string, name string")
    edges = {name: read_relation(spark, _named(folder / "edges", name), ids[s.source], ids[s.target]) for name, s in schema.metaedges.items()}
    return Network(spark, schema, nodes, edges)


def save_folder(network: Network, folder: str | Path, ending: str = ENDINGS[0]) -> None:
    """Writes nodes and edges as a folder of matrix files, nodes in order of id."""
    folder, ids = Path(folder), {}
    for part in ("nodes", "edges"):
        (folder / part).mkdir(parents=True, exist_ok=True)
    for short, name in network.schema.metanodes.items():
        table = network.nodes[short].select("id", "name").orderBy("id").toPandas()
        ids[short] = table["id"].tolist()
        table = table.rename(columns={"id": "identifier"}).rename_axis("position").reset_index()
        table.to_csv(folder / "nodes" / f"{name}.tsv", sep="\t", index=False)
    for name, step in network.schema.metaedges.items():
        write_relation(network.edges(step), folder / "edges" / f"{name}{ending}", ids[step.source], ids[step.target])
