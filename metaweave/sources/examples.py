"""Small networks by name, for trying things out and for tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from metaweave.operators.network import Network
from metaweave.plans.schema import Schema

#: The nodes and edges of the example of genes, diseases and tissues.
_GENES = {
    "G": ("CXCR4", "IL2RA", "IRF1", "IRF8", "ITCH", "STAT3", "SUMO1"),
    "D": ("Crohn's Disease", "Multiple Sclerosis"),
    "T": ("Leukocyte", "Lung"),
}
_GENE_EDGES = {
    "GiG": (("CXCR4", "IRF1"), ("CXCR4", "ITCH"), ("IL2RA", "IRF1"), ("IRF1", "IRF8"), ("IRF1", "SUMO1")),
    "GaD": (("IRF1", "Crohn's Disease"), ("STAT3", "Crohn's Disease"), ("CXCR4", "Multiple Sclerosis"), ("IL2RA", "Multiple Sclerosis"), ("IRF8", "Multiple Sclerosis"), ("STAT3", "Multiple Sclerosis")),
    "GeT": (("IRF1", "Leukocyte"), ("IRF1", "Lung")),
    "DlT": (("Multiple Sclerosis", "Leukocyte"),),
}


def _disease_gene(spark: SparkSession) -> Network:
    schema = Schema({"G": "Gene", "D": "Disease", "T": "Tissue"}, [("G", "i", "G", "both"), ("G", "a", "D", "both"), ("G", "e", "T", "both"), ("D", "l", "T", "both")])
    nodes = {m: spark.createDataFrame([(i, i) for i in ids], "id string, name string") for m, ids in _GENES.items()}
    edges = {}
    for name, step in schema.metaedges.items():
        pairs = set(_GENE_EDGES[name])
        if step.source == step.target:
            pairs |= {(b, a) for a, b in pairs}
        edges[name] = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src string, dst string, v double")
    return Network(spark, schema, nodes, edges)


_BY_NAME: dict[str, Callable[[SparkSession], Network]] = {"disease-gene": _disease_gene}
NAMES = tuple(_BY_NAME)


def example(spark: SparkSession, name: str = "disease-gene") -> Network:
    if name not in _BY_NAME:
        raise ValueError(f"no example {name!r}; there are {NAMES}")
    return _BY_NAME[name](spark)
