"""op6: repeated rows, ids of any type, and archives that are broken."""

import hashlib
from collections import Counter

import pytest

from metaweave.llm import common, warc

BIG = "x" * 1200


def written(spark, folder, rows, schema):
    df = spark.createDataFrame(rows, schema)
    manifest = warc.write(df, f"file://{folder}/warc")
    return manifest, [r.asDict() for r in warc.read(spark, manifest, f"file://{folder}/warc", df.schema["page_id"].dataType.simpleString()).collect()]


def test_repeated_rows_have_one_response(spark, tmp_path):
    _, got = written(spark, tmp_path, [(7, "u", BIG), (7, "u", BIG), (7, "v", BIG), (3, "u", BIG), (None, None, BIG), (9, None, None)], "page_id long, url string, html string")
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter({(7, "response", None): 1, (7, "revisit", 7): 2, (3, "revisit", 7): 1, (None, "revisit", 7): 1, (9, "response", None): 1})
    assert all(r["payload_bytes"] == (0 if r["page_id"] == 9 else 1200) for r in got)


def test_ids_of_other_types_and_clashing_columns(spark, tmp_path):
    rows = [("a:1 %", "u", BIG, "x", 1), ("b", "u\r\nX: y", BIG, "y", 2), (None, "u", "é" * 20_000, "z", 3)]
    _, got = written(spark, tmp_path, rows, "page_id string, url string, html string, digest string, row long")
    sha = {t: hashlib.sha1(t.encode()).hexdigest() for t in (BIG, "é" * 20_000)}
    assert sorted(map(str, (tuple(r.values()) for r in got))) == sorted(map(str, [
        ("b", 1200, sha[BIG], "response", None), ("a:1 %", 1200, sha[BIG], "revisit", "b"), (None, 40_000, sha["é" * 20_000], "response", None)]))


def rewritten(folder, change):
    """Applies a change to the only archive's records."""
    import zlib

    path = next((folder / "warc").glob("*.warc.gz"))
    members, data = [], path.read_bytes()
    while data:
        unzip = zlib.decompressobj(31)
        members.append(unzip.decompress(data))
        data = unzip.unused_data
    out = b""
    for m in change(members):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += z.compress(m) + z.flush()
    path.write_bytes(out)


@pytest.mark.parametrize("change, message", [
    (lambda m: m[:-1], "holds .* records, not"),
    (lambda m: [x.replace(b"Segment-Total-Length: ", b"Segment-Total-Length: 1") for x in m], "segments of"),
    (lambda m: [x.replace(b"Segment-Number: 2", b"Segment-Number: 3") for x in m], "segments of"),
    (lambda m: [x.replace(b"xxxx", b"yyyy") for x in m], "digest that it declares|doesn't have the digest"),
    (lambda m: [x.replace(b"Refers-To: <urn:row:", b"Refers-To: <urn:row:99") for x in m], "isn't there"),
])
def test_broken_archives_raise(spark, tmp_path, change, message):
    df = spark.createDataFrame([(1, "u", BIG), (2, "u", BIG), (3, "u", "z" * 60_000)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(common.written(df, "pages"), f"file://{tmp_path}/warc")
    rewritten(tmp_path, change)
    with pytest.raises(Exception, match=message):
        warc.read(spark, manifest, f"file://{tmp_path}/warc", "bigint").collect()


def test_truncated_archives_raise(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string")
    manifest = warc.write(df, f"file://{tmp_path}/warc")
    path = next((tmp_path / "warc").glob("*.warc.gz"))
    path.write_bytes(path.read_bytes()[:-40])
    with pytest.raises(Exception, match="ends within a record|holds 0 records"):
        warc.read(spark, manifest, f"file://{tmp_path}/warc", "bigint").collect()
