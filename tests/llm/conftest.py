import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    """Small tables with nulls, empty and long texts, copies, near copies, repeated rows, shared passages, hot sources and columns of clashing names."""
    rng = random.Random(11)
    docs = []
    passage, item = words(rng, 60), words(rng, 30)
    for i in range(120):
        text = words(rng, rng.randrange(1, 150))
        if i % 9 == 0:
            text += passage
        if i % 11 == 0:
            text[3:3] = item[:20]
        if i % 10 == 4:
            text = words(random.Random(i % 20), 120)
            text[i % 100 : i % 100 + 1] = ["changed"]
        if i % 3 == 0:
            text += ["you", "rotten", "stinking", "scum"] * 3
        docs.append((i, " ".join(text)))
    docs += [(200, None), (201, ""), (202, "  \t\n "), (203, docs[5][1]), (203, docs[5][1]), (204, "Über größe 数据 " * 40), (205, " ".join(words(rng, 9000))), (206, "one"), (207, "ONE, two."), (208, "a\x00b\x1cc d e")]
    n = len(docs)
    table = pa.table({
        "doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()),
        "lang": ["en"] * n, "source": pa.array([None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}" for i in range(n)], pa.string()),
        "n_chars": pa.array([len(t or "") for _, t in docs], pa.int64()), "row": ["x"] * n, "n_words": ["y"] * n, "item_id": ["z"] * n,
    })
    folder = tmp_path_factory.mktemp("tables")
    pq.write_table(table, folder / "documents.parquet", row_group_size=40)
    items = [(0, " ".join(item)), (1, "ONE two"), (2, None), (3, ""), (4, " ".join(passage).upper()), (10, " ".join(item[:13]))]
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": pa.array([t for _, t in items], pa.string())}), folder / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": list(range(120)), "quality": [1] * 120, "toxic": [int(i % 3 == 0) for i in range(120)]}), folder / "labels.parquet")
    gen = np.random.default_rng(2)
    vectors = [v.tolist() for v in gen.normal(size=(300, 16)).astype(np.float32)] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15]
    vectors[7] = vectors[50]
    pq.write_table(pa.table({"vec_id": list(range(303)), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [0] * 303}), folder / "embeddings.parquet")
    html = ["<p>" + "x" * 3000, "<p>" + "x" * 3000, "<p>" + "x" * 3000, "short", "short", None, "", "é" * 499, "é" * 500, "é" * 500, "long " * 60_000]
    pq.write_table(pa.table({"page_id": list(range(len(html))), "url": [f"http://h/{i}" for i in range(len(html))], "html": pa.array(html, pa.string())}), folder / "pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def docs(tables):
    t = pq.read_table(Path(tables) / "documents.parquet")
    return [(r["doc_id"], r["text"], r["source"]) for r in t.select(["doc_id", "text", "source"]).to_pylist()]


@pytest.fixture(scope="session")
def empty(tables, tmp_path_factory):
    """The same tables without rows."""
    folder = tmp_path_factory.mktemp("empty")
    for f in Path(tables).glob("*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), folder / f.name)
    return str(folder)


def crc(text):
    return zlib.crc32((text or "").encode())
