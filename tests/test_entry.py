import importlib
import sys

import pytest


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["src", "dst", "n", "v"] and rows.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_operators(monkeypatch):
    """The entry works when the corpus operators are gone."""
    for name in [m for m in sys.modules if m.startswith("metaweave.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline",) or name.startswith("metaweave.llm"):
                raise ModuleNotFoundError(name, name=name)

    import metaweave

    monkeypatch.delattr(metaweave, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and "dwwc_CpOcPmB" in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("name", ["permuted_degrees", "dwpc_disjoint_NnNiSsPsS"])
def test_query_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(tuple, rows.select(*names).collect())) == sorted(want.fetchall())
