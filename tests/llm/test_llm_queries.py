"""The registered queries and the pipeline on the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from codexlake.llm import queries as Q
from codexlake.llm.common import table, written


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracles(spark, sf, duck, name):
    got, want = Q.queries()[name](spark, sf), duck.sql(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows, names: sorted(tuple(f"{float(r[names.index(c)]):.6f}" if isinstance(r[names.index(c)], (int, float)) else str(r[names.index(c)]) for c in columns) for r in rows)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), list(want.columns))


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = Q.op5_language_id(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.95
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    scored = Q.op10_quality_classifier(spark, sf).collect()
    seen = [r for r in scored if r.doc_id in quality]
    assert len(scored) == len(lang) and sum(r.predicted == quality[r.doc_id] for r in seen) / len(seen) > 0.9


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mixing", "sentencepiece"]
    seen = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), f"test-{name}")
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == before.columns
    assert {r.doc_id for r in seen["secret_scan"].collect()} == {r.doc_id for r in seen["near_dedup"].collect()}
    groups = {r.component_id for r in Q.near_dedup.near_duplicates(seen["language_id"]).collect()}
    assert {r.doc_id for r in seen["near_dedup"].collect()} == groups
    assert seen["mixing"].count() == seen["sentencepiece"].count() == corpus_pipeline.run(spark, sf).count()
    copies = seen["mixing"].groupBy("doc_id").count()
    assert copies.filter("count > 2").count() == 0 and seen["secret_scan"].filter("text RLIKE 'token = \"[0-9a-f]{40}\"'").count() == 0


def test_stages_take_hard_rows(spark, sf):
    rows = [(1, "the of and that tide wave salt moon reef", "en", "a", 40), (1, "the of and that tide wave salt moon reef", "en", "a", 40), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "water and the sand of the sea", "en", None, 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() <= 2 * len(rows), name
        assert stage(spark, docs.limit(0), sf).count() == 0
