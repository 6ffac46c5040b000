"""The splitting tree of the mix: exact leaf quotas, disjoint draws, gapless places, and their effect on op5 and the mixed rows."""

import hashlib
import struct
from collections import Counter, defaultdict

import numpy as np

from metaweave.llm import common, mixing, registry

from .test_operators import TOKEN


def test_placement(spark, tables, docs):
    source = common.read_table(spark, tables, "documents").where("doc_id <> 203")
    pieces = [tuple(r) for r in mixing.manifest(source).collect()]
    _, plan = mixing._placed(source)
    of = {d: s for d, _, s in docs}
    words = {d: TOKEN.findall(t or "") for d, t, _ in docs}
    key = {s: plan.number["~" if s is None else f"s{s}"] for s in of.values()}
    quotas = [p * n + w + (c > 0) for p, n, w, c in zip(plan.passes, plan.n_blocks, plan.ranks, plan.cut)]
    blocks, sizes = defaultdict(set), Counter()
    for d, nth, a, b, shard, place in pieces:
        blocks[shard, place].add((key[of[d]], nth))
        sizes[shard, place] += b - a
    # a place is one draw: of one source and pass, of a block's words at most
    assert all(len(x) == 1 for x in blocks.values()) and max(sizes.values()) <= plan.block
    leaf = np.zeros_like(plan.leaf)
    for (shard, _), x in blocks.items():
        leaf[shard, next(iter(x))[0]] += 1
    assert (leaf == plan.leaf).all() and leaf.sum(axis=0).tolist() == quotas
    room = leaf.sum(axis=1)
    assert room.max() - room.min() <= 1
    assert all(sorted(p for s, p in blocks if s == j) == list(range(room[j])) for j in range(plan.shards))
    by_pass = defaultdict(list)
    for d, nth, a, b, _, _ in pieces:
        by_pass[d, nth].append((a, b))
    for spans in by_pass.values():
        spans.sort()
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))

    # the rows of the mix come in this order
    got = [TOKEN.findall(r["text"]) for r in mixing.mixed(source).select("text").collect()]
    at, n = 0, 0
    here = defaultdict(list)
    for d, _, a, b, shard, place in pieces:
        here[shard, place].append(words[d][a:b])
    for where in sorted(here):
        mine = got[at : at + len(here[where])]
        assert sorted(mine) == sorted(here[where])
        at += len(mine)
        n += sum(map(len, mine))
    assert at == len(got) and n == sum(sizes.values())


def test_op5_tells_the_placement(spark, tables):
    want = defaultdict(list)
    for d, *piece in mixing.manifest(common.read_table(spark, tables, "documents")).collect():
        want[d].append(tuple(piece))
    for r in registry.QUERIES["op5_mixing"](spark, tables).collect():
        if r["doc_id"] != 203:
            mine = sorted(want[r["doc_id"]])
            assert r["n_pieces"] == len(mine)
            assert r["pieces_sha256"] == hashlib.sha256(b"".join(struct.pack("<5q", *p) for p in mine)).hexdigest()


def test_large_draws():
    """Beyond the range of numpy's sampler the draws keep exact totals, stay in bounds and follow the same law."""
    rng = np.random.default_rng(3)
    have = np.array([5_000_000_000, 40, 3_000_000_000, 0], np.int64)
    leaf = mixing.split(have, 4, rng)
    assert (leaf.sum(axis=0) == have).all() and leaf.sum(axis=1).max() - leaf.sum(axis=1).min() <= 1 and leaf.min() >= 0
    draws = np.array([mixing._drawn(rng, 2 * 10**9, 10**9, 3000) for _ in range(300)])
    assert abs(draws.mean() - 2000) < 8 and 20 < draws.std() < 32
    assert mixing._drawn(rng, 10**10, 0, 7) == 7 and mixing._drawn(rng, 0, 10**10, 7) == 0


def test_odd_sources(spark):
    """Sources that aren't strings, one named like the mark of null, and rows that agree in all but their other columns."""
    rows = [(1, "a b c", "~", 1), (1, "a b c", "~", 2), (2, "d e", None, 3), (3, None, "x", 4)]
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string, _mix int")).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"]) for r in got) == [(1, 3, 6), (1, 3, 6), (2, 2, 2), (3, 0, 0)]
    numbers = spark.createDataFrame([(1, "a b", 5), (2, "c", 10)], "doc_id long, text string, source int")
    assert {r["doc_id"]: r["source_size"] for r in mixing.digest(numbers).collect()} == {1: 2, 2: 1}
    mixed = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, _mix int"))
    assert mixed.columns == ["doc_id", "text", "source", "_mix"] and mixed.count() > 0
