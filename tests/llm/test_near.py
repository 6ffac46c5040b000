"""op9: weighted sketches and their verification, groups whose members resemble a common text, and what is compared."""

import random
from collections import Counter

import numpy as np
import pytest

from metaweave.llm import near_dedup

from .test_operators import near_labels, similarity


def bags(n, seed):
    """Pairs of weighted sets that share some elements."""
    gen = random.Random(seed)
    for _ in range(n):
        common = {gen.randrange(1 << 40): gen.randrange(1, 9) for _ in range(gen.randrange(1, 80))}
        x, y = ({k: v + gen.randrange(3) for k, v in common.items()} for _ in range(2))
        x |= {gen.randrange(1 << 40): gen.randrange(1, 9) for _ in range(gen.randrange(20))}
        y |= {gen.randrange(1 << 40): gen.randrange(1, 9) for _ in range(gen.randrange(20))}
        yield x, y


def arrays(bag, dtype=np.uint64):
    keys = sorted(bag)
    return np.array(keys, dtype), np.array([bag[k] for k in keys], np.int64)


def test_probability_jaccard():
    for x, y in bags(200, 1):
        (a, wa), (b, wb) = arrays(x), arrays(y)
        assert np.isclose(near_dedup.probability_jaccard(a, wa, b, wb), similarity(Counter(x), Counter(y)))
        ones = near_dedup.probability_jaccard(a, None, b, None)
        assert np.isclose(ones, len(x.keys() & y.keys()) / len(x.keys() | y.keys()))
        assert np.isclose(near_dedup.probability_jaccard(a, np.ones(len(a)), b, None), ones)
    assert near_dedup.probability_jaccard(a, wa, a, 3 * wa) == pytest.approx(1)


def test_registers_agree_as_the_similarity_says():
    for x, y in bags(6, 2):
        registers = []
        for bag in (x, y):
            keys, weights = arrays(bag)
            registers.append(near_dedup.sketch(np.zeros(len(keys), np.int64), near_dedup.C.mix(keys), weights, 1, 8192)[0])
        assert abs((registers[0] == registers[1]).mean() - similarity(Counter(x), Counter(y))) < 0.025


def test_sketches_do_not_depend_on_neighbours():
    (x, wx), (y, wy) = (arrays(b) for b in next(bags(1, 3)))
    both = near_dedup.sketch(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), np.concatenate([wx, wy]), 2, 64)
    assert (both[0] == near_dedup.sketch(np.zeros(len(x), int), x, wx, 1, 64)[0]).all()


def edited(rng, words, share):
    return [f"e{rng.random()}" if rng.random() < share else w for w in words]


@pytest.fixture
def crowded(spark):
    """Many texts around a few common ones: some linked through the common text, some that resemble the group at less than 0.8, and repeated lines."""
    rng, texts = random.Random(8), []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(150)]
        texts += [base] * 2 + [edited(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.07) for _ in range(12)]
    line = [f"line{i}" for i in range(12)]
    texts += [line * n for n in (3, 30, 31, 60)] + [line * 20 + [f"x{i}" for i in range(k)] for k in (5, 20, 200)]
    texts += [[f"u{i}_{j}" for j in range(40)] for i in range(30)] + [["a"], ["a"], ["a", "b"], []]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), texts


@pytest.mark.parametrize("work", [near_dedup.WORK, 0])
def test_crowded_groups(crowded, monkeypatch, work):
    """Also where rounds of leaders go before the rest, and blocks are small."""
    monkeypatch.setattr(near_dedup, "WORK", work)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 512 if work else 4)
    df, texts = crowded
    label = near_labels(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == label and 30 < len(set(label)) < len(texts) - 60


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (None, "other words"), (None, None), (7, "")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.classes(df).collect())
    assert got == Counter([(None, 5, 3), (5, 5, 3), (5, 5, 3), (None, None, 1), (None, None, 1), (7, 7, 1)])
    assert sorted(str(r["doc_id"]) for r in near_dedup.deduplicate(df).collect()) == ["5", "7", "None", "None"]
