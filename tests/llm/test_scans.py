"""Tables that are scanned several times: their partitions are planned once, and a change between scans raises."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from metaweave.llm import common, near_dedup, substring_dedup

SPLIT = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "0"}


@pytest.fixture
def cut(spark):
    """Cuts files into small partitions from the call on, as a change of the number of cores does."""
    yield lambda: [spark.conf.set(k, v) for k, v in SPLIT.items()]
    for k in SPLIT:
        spark.conf.unset(k)


@pytest.mark.parametrize("run", [substring_dedup.annotate, substring_dedup.remove, near_dedup.deduplicate])
def test_files_cut_otherwise_between_scans(spark, tables, cut, run):
    docs = common.read_table(spark, tables, "documents").where("doc_id <> 203")
    want = sorted(map(str, run(docs).collect()))
    again = run(docs)
    before = docs.rdd.getNumPartitions()
    cut()
    assert common.read_table(spark, tables, "documents").rdd.getNumPartitions() > before
    assert sorted(map(str, again.collect())) == want


def test_changed_partitions_raise(spark, tables):
    docs = common.read_table(spark, tables, "documents").select("doc_id", "text")
    scans = common.Scans(spark, "scans")

    def scan(df, first):
        return df.mapInArrow(lambda batches: scans.check(batches, 0, 1, first), df.schema).collect()

    one, three = docs.coalesce(1), docs.repartition(3)
    scan(one, True)
    scan(one, False)
    for other in (three, one.orderBy("text"), one.limit(5), one.selectExpr("doc_id + 1 AS doc_id", "text")):
        with pytest.raises(Exception, match="changed between two scans"):
            scan(other, False)


def test_many_short_rows_in_a_partition(spark, tmp_path):
    """A dictionary stores equal rows once, so over 2^21 rows fit in one split."""
    n = 2**21 + 1000
    passage = " ".join(f"v{i}" for i in range(25))
    texts = pa.DictionaryArray.from_arrays(pa.array([0] * n + [1, 1], pa.int32()), ["", passage]).cast(pa.string())
    pq.write_table(pa.table({"doc_id": pa.array([0] * n + [1, 2], pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    docs = common.read_table(spark, str(tmp_path), "documents")
    assert docs.rdd.getNumPartitions() == 1
    got = substring_dedup.annotate(docs).where("n_words > 0").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], r["n_removed"]) for r in got] == [(1, 25, 0), (2, 25, 25)]
