"""Degree-preserving permutation of edges by swaps.

Nodes are dealt into groups by a seeded hash. All edges between one group of sources and one of
targets form a block, and so do all edges that swaps of them can make: whether a swap's edges
exist already is known inside the block. Blocks are worked on apart, with about BLOCK_EDGES edges
each, a hub's edges being spread over all groups of its partners; in every round nodes are dealt
anew, so that all edges mix.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.operators.network import Network
from metaweave.runtime import settled

BLOCK_EDGES = 100_000
ROUNDS = 4


def _keys(src: np.ndarray, dst: np.ndarray, width: int, turned: bool) -> np.ndarray:
    """A number for each edge; the same for both directions if turned."""
    if turned:
        src, dst = np.minimum(src, dst), np.maximum(src, dst)
    return src * width + dst


def _swap(block: pd.DataFrame, seed: int, tries: float, loops: bool, undirected: bool) -> pd.DataFrame:
    """Swaps of all edges at a time: they are paired at random, and of the pairs those swap whose new edges exist nowhere and are proposed once."""
    block = block.sort_values(["src", "dst"], ignore_index=True)
    free = np.flatnonzero(~block["fixed"].to_numpy())
    if len(free) < 2:
        return block
    rng = np.random.default_rng([seed, int(block["a"].iat[0]), int(block["b"].iat[0])])
    nodes, names = pd.factorize(pd.concat([block["src"], block["dst"]], ignore_index=True))
    src, dst, width = nodes[: len(block)].astype(np.int64), nodes[len(block) :].astype(np.int64), len(names)
    turn = undirected and block["a"].iat[0] == block["b"].iat[0]
    half = len(free) // 2
    for _ in range(max(1, round(tries * len(free) / half))):
        i, j = rng.permutation(free)[: 2 * half].reshape(2, half)
        a, b, c, d = src[i], dst[i], src[j], dst[j]
        if turn:  # an undirected edge inside one group may be swapped in either direction
            flip = rng.random(half) < 0.5
            c, d = np.where(flip, d, c), np.where(flip, c, d)
        fine = (a != c) & (b != d)
        if not loops:
            fine &= (a != d) & (c != b)
        new = np.stack([_keys(a, d, width, turn), _keys(c, b, width, turn)])
        there = np.sort(_keys(src, dst, width, turn))
        at = np.minimum(np.searchsorted(there, new), len(there) - 1)
        fine &= (there[at] != new).all(axis=0)
        _, first, times = np.unique(new[:, fine], return_inverse=True, return_counts=True)
        fine[fine] = (times[first.reshape(2, -1)] == 1).all(axis=0)
        src[i[fine]], dst[i[fine]], src[j[fine]], dst[j[fine]] = a[fine], d[fine], c[fine], b[fine]
    block["src"], block["dst"] = names.take(src), names.take(dst)
    return block


def _swapper(seed: int, tries: float, loops: bool, undirected: bool):
    def swapped(block: pd.DataFrame) -> pd.DataFrame:
        return _swap(block, seed, tries, loops, undirected)

    return swapped


def permute(edges: DataFrame, same_metanode: bool = False, undirected: bool = False, multiplier: float = 10, excluded: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Edges (src, dst, v = 1) with the degrees of all nodes kept; the same for the same seed.

    same_metanode: no loops are made. undirected: edges hold both directions, and so does the result. excluded: (src, dst) not to be
    made. multiplier: swaps tried per edge. Weights other than 1 raise an error.
    """
    spark = edges.sparkSession
    plain = edges.select("src", "dst", F.when(F.col("v") == 1, F.lit(False)).otherwise(F.raise_error(F.lit("weighted edges can't be permuted")).cast("boolean")).alias("fixed"))
    rows = plain.where("src <= dst") if undirected else plain
    rows = rows.where("not fixed")
    if same_metanode:
        rows = rows.withColumn("fixed", F.col("src") == F.col("dst"))
    if excluded is not None:
        # excluded pairs count as taken: rows that are never swapped, and go at the end
        blocked = excluded.select("src", "dst")
        if undirected:
            blocked = blocked.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        blocked = blocked.distinct().join(rows.select("src", "dst"), ["src", "dst"], "left_anti")
        rows = rows.withColumn("ghost", F.lit(False)).unionByName(blocked.select("src", "dst", F.lit(True).alias("fixed"), F.lit(True).alias("ghost")))
    else:
        rows = rows.withColumn("ghost", F.lit(False))
    count = rows.count()
    groups = max(1, math.ceil(math.sqrt(count / BLOCK_EDGES)))
    kind = rows.schema["src"].dataType.simpleString(), rows.schema["dst"].dataType.simpleString()
    schema = f"src {kind[0]}, dst {kind[1]}, fixed boolean, ghost boolean, a int, b int"
    for turn in range(ROUNDS):
        salt = F.lit(f"{seed}/{turn}")
        dealt = rows.select("src", "dst", "fixed", "ghost").withColumn("a", F.pmod(F.xxhash64("src", salt), F.lit(groups)).cast("int"))
        dealt = dealt.withColumn("b", F.pmod(F.xxhash64("dst", salt), F.lit(groups)).cast("int"))
        if undirected:
            flip = F.col("a") > F.col("b")
            dealt = dealt.select(
                F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"),
                "fixed", "ghost", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        swapped = _swapper(int(seed) * 1000 + turn, multiplier / ROUNDS, not same_metanode, undirected)
        rows = dealt.groupBy("a", "b").applyInPandas(swapped, schema)
    one = F.lit(1.0).alias("v")
    rows = rows.where("not ghost").select("src", "dst", one)
    if undirected:
        rows = rows.unionByName(rows.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "v"))
    return rows


def permute_network(network: Network, number: int, multiplier: float = 10, seed: int = 0, first: int = 1) -> dict[str, Network]:
    """Permutations by name (001, 002, ...), each made from the one before it, with the seed one higher.

    The edges of each are checkpointed before the next is made, so that none is computed again.
    """
    out: dict[str, Network] = {}
    last = network
    for i in range(number):
        edges = {}
        for name, step in network.schema.metaedges.items():
            same = step.source == step.target
            edges[name] = settled(permute(last._edges[name], same, same and step.direction == "both", multiplier, None, seed + i))
        last = network.with_edges(edges)
        out[f"{first + i:03d}"] = last
    return out


def permutation_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: edges, unchanged (in both), share_unchanged."""
    same = before.select("src", "dst").join(after.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count("*").alias("unchanged"))
    total = before.agg(F.count("*").alias("edges"))
    return total.crossJoin(same).withColumn("share_unchanged", F.try_divide("unchanged", "edges"))


def network_stats(network: Network, permuted: dict[str, Network]) -> DataFrame:
    """A row for each metaedge of each permutation: metaedge, permutation, edges, unchanged and share_unchanged, towards the network as observed."""
    rows = [
        permutation_stats(network._edges[edge], other._edges[edge]).select(F.lit(edge).alias("metaedge"), F.lit(name).alias("permutation"), "edges", "unchanged", "share_unchanged")
        for name, other in permuted.items()
        for edge in network.schema.metaedges
    ]
    return reduce(DataFrame.unionByName, rows)
