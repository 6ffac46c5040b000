"""op3's files read back, and the pipeline's whole run, against plain computations."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from metaweave.llm import common, feistel, mixing, token_shards

from .test_operators import TOKEN, near_labels, rows


def test_shard_files_hold_the_ids(spark, tables, docs, tmp_path):
    source, folder, n, per = common.read_table(spark, tables, "documents"), f"file://{tmp_path}/shards", 64, 8
    assert source.rdd.getNumPartitions() == 1
    got = {r["slot"]: r for r in token_shards.materialise(source, folder, n, per).collect()}
    total = len(got)
    records = token_shards.read_slots(folder, 0, total, n, per)
    encode = token_shards.encoder(token_shards.default_ranks())
    want = np.array([i for _, t, _ in docs if t for i in [*encode.encode_ordinary(t), token_shards.EOT]], np.uint16)
    want = np.append(want, np.full(-len(want) % n, token_shards.PAD, np.uint16)).reshape(-1, n)
    slots = feistel.Permutation(total, token_shards.KEY).rank(np.arange(total, dtype=np.uint64)).astype(int)
    assert total == len(want) > 5 * per and (records[slots] == want).all()
    for number, s in enumerate(slots.tolist()):
        r = got[s]
        assert (r["place"], r["shard"], r["byte_offset"]) == (number, s // per, s % per * 2 * n)
        assert r["n_tokens"] == (want[number] != token_shards.PAD).sum() and r["sha256"] == hashlib.sha256(want[number].tobytes()).hexdigest()
        raw = (tmp_path / "shards" / f"shard-{r['shard']:08d}.bin").read_bytes()[r["byte_offset"] : r["byte_offset"] + 2 * n]
        assert raw == want[number].tobytes()
    assert (token_shards.read_slots(folder, 5, 20, n, per) == records[5:25]).all()


def test_run_is_its_stages(spark, tables, docs):
    gone = {r["doc_id"] for r in rows(spark, "op4_toxicity", tables) if r["predicted"]}
    left = [(d, t) for d, t, _ in docs if d not in gone]
    label = near_labels([t for _, t in left])
    first = {}
    for (d, _), x in zip(left, label):
        first[x] = min(d, first.get(x, d))
    bad = {r["doc_id"] for r in rows(spark, "op1_decontamination", tables) if r["contaminated"]}
    kept = Counter(first.values())
    kept = Counter({d: n for d, n in kept.items() if d not in bad})
    df = common.read_table(spark, tables, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = common.written(stage(spark, df, tables), "chained")
    assert Counter(r["doc_id"] for r in df.collect()) == kept
    pieces = mixing.manifest(df).collect()
    mixed = common.written(corpus_pipeline.mix(spark, df, tables), "chained")
    texts = {r["doc_id"]: TOKEN.findall(r["text"] or "") for r in df.collect()}
    want = Counter((r["doc_id"], tuple(texts[r["doc_id"]][r["from"] : r["to"]])) for r in pieces)
    assert Counter((r["doc_id"], tuple(TOKEN.findall(r["text"]))) for r in mixed.collect()) == want
    out = corpus_pipeline.run(spark, tables).collect()
    assert Counter(map(str, out)) == Counter(map(str, corpus_pipeline.shard(spark, mixed, tables).collect()))
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in pieces)
    for j in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == j) == list(range(sum(r["shard"] == j for r in out)))
