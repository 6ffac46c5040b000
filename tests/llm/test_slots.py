"""op2: the stored map over several runs, growth, and slots that are hot."""

import random
from collections import Counter, defaultdict

import pytest

from metaweave.llm import sharding


def frame(spark, n, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "x" * rng.randrange(400)) for i in range(n)], "doc_id long, text string")


def placed(df):
    return {r["doc_id"]: r["shard"] for r in df.collect()}


def loads(df):
    out = Counter()
    for r in df.collect():
        out[r["shard"]] += r["size"]
    return out


def test_the_map_is_kept_and_edited(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/map"
    first = placed(sharding.assign(frame(spark, 3000), 8, map_path=path))
    assert sharding.versions(spark, path) == [0, 1]
    assert placed(sharding.assign(frame(spark, 3000), 8, map_path=path)) == first and sharding.versions(spark, path) == [0, 1]
    more = sharding.assign(frame(spark, 3600, seed=1), 8, map_path=path)
    moved = sum(first[d] != s for d, s in placed(more).items() if d in first)
    assert sharding.versions(spark, path) == [0, 1, 2] and max(loads(more).values()) <= 1.05 * min(loads(more).values())
    assert moved < 3000
    table = sharding.load_map(spark, path, {})
    assert table.version == 2 and [m["version"] for m in table.moves] == [1, 2]
    with pytest.raises(ValueError, match="has 8 shards"):
        sharding.assign(frame(spark, 10), 7, map_path=path)


def test_growth_moves_only_into_new_shards(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    df = frame(spark, 3000)
    sharding.assign(df, 8, map_path=path)
    after = sharding.assign(df, 9, map_path=path)
    versions = sharding.versions(spark, path)
    before, grown = (sharding.load_map(spark, path, {}, v) for v in versions[1:3])
    at = [{(r.slot, r.salt): r.shard for r in spark.read.parquet(f"{path}/version={v}").collect()} for v in versions[1:3]]
    assert (before.shards, grown.shards) == (8, 9)
    assert {s for k, s in at[1].items() if at[0][k] != s} == {8}
    assert max(loads(after).values()) <= 1.05 * min(loads(after).values())


def test_one_key_on_a_third_of_the_rows(spark, tmp_path):
    rows = [(7, "hot text")] * 1000 + [(None, "n")] * 3 + [(i, f"text {i}") for i in range(100, 2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.assign(df, 8, map_path=f"file://{tmp_path}/map").collect()
    slots, sizes, hot = defaultdict(list), Counter(), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        hot[r["shard"]] += r["doc_id"] == 7
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= 1.05 * min(sizes.values()) and sum(n > 0 for n in hot.values()) > 1
    again = sharding.assign(df.repartition(3), 8).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] != 7) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again if r["doc_id"] != 7)
