"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from codexlake import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "∅"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), want.columns)


def test_filters_reach_the_scan(spark, sf, capsys):
    QUERIES["a01_filtered_scan"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan and "o_comment" not in plan
    QUERIES["d02_all_labels"](spark, sf).explain()
    assert "CartesianProduct" not in capsys.readouterr().out


def test_entry_works_without_the_text_operators(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "codexlake.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k == "corpus_pipeline" or k.startswith("codexlake.llm")}
    import codexlake

    monkeypatch.delattr(codexlake, "llm", raising=False)
    sys.meta_path.insert(0, Gone())
    try:
        importlib.reload(entry)
        assert not any(q.startswith("op") for q in entry.queries()) and "pipeline" not in entry.queries()
        assert entry.entry(spark).count() > 0
    finally:
        sys.meta_path.pop(0)
        sys.modules.update(kept)
        importlib.reload(entry)
