"""What showed only on larger tables: cut numbers, signs of nothing, expressions and joins that grow."""

from pyspark.sql import functions as F

from codexlake.functions import repair, scalar
from codexlake.operators import matching
from codexlake.sources import writers

NO_IDS = "seed_id string, doi string, pmid string, arxiv_id string, isbn string, title string"


def test_candidates_of_a_title_that_many_share(spark):
    n = 3000
    refs = spark.range(n).select(F.format_string("r%05d", "id").alias("id"), F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"), *[F.lit(None).cast("string").alias(c) for c in ("pmid", "arxiv_id", "isbn")], F.lit("One title").alias("title"))
    seeds = refs.withColumnRenamed("id", "seed_id")
    found = matching.local_candidates(seeds, refs.unionByName(refs))  # a record that is there twice takes one place
    rows = found.filter("seed_id IN ('r00003', 'r02000')").orderBy("seed_id", F.desc("score"), "id").collect()
    first = [f"r{i:05d}" for i in range(6)]
    assert [r.id for r in rows] == ["r00003", *[f for f in first if f != "r00003"], "r02000", *first[:5]]
    assert found.count() == 6 * n
    # pairs that meet by the title: six records for each seed, not all
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") >= 3


def test_understanding_is_one_small_expression(spark):
    text = repair.understand(F.col("s"))._jc.toString()
    assert len(text) < 60_000


def test_percent_has_no_sign_of_nothing(spark):
    rows = spark.sql("SELECT id, 1 AS n, share AS completeness FROM VALUES (1, -0.0D), (2, -0.003D), (3, 0.005D), (4, 0.285D), (5, CAST(NULL AS DOUBLE)) AS t(id, share)")
    people = "array<struct<family:string,given:string>>"
    refs = rows.select("*", *[F.lit(None).cast(people).alias(c) for c in ("authors", "editors")], F.lit(None).cast("array<string>").alias("keywords"), F.lit(None).cast("map<string,double>").alias("sources"))
    assert [r[0] for r in writers.flat(refs).orderBy("id").select("completeness").collect()] == ["0%", "0%", "1%", "28%", "0%"]


def test_numbers_of_addresses_are_whole(spark):
    urls = [("https://arxiv.org/abs/2001.100000",), ("https://arxiv.org/pdf/2001.10000v2",), ("https://arxiv.org/abs/0704.0001.pdf",)]
    got = spark.createDataFrame(urls, "u string").select(scalar.ids_in_url(F.col("u"))["arxiv_id"]).collect()
    assert [r[0] for r in got] == ["2001.100000", "2001.10000", "0704.0001"]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from codexlake.sources.tables import spread

    pq.write_table(pa.table({"n": list(range(40_000)), "t": [f"{i * 7919:050d}" for i in range(40_000)]}), f"{tmp_path}/t.parquet", row_group_size=40_000, compression="none")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        one = spark.read.parquet(f"file://{tmp_path}/t.parquet")
        assert one.rdd.getNumPartitions() >= 4 and one.select(F.spark_partition_id()).distinct().count() == 1
        parts = spread(one).groupBy(F.spark_partition_id()).count().select("count").collect()
        assert sum(r[0] for r in parts) == 40_000 and max(r[0] for r in parts) <= 10_000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from codexlake.operators import graph

    monkeypatch.setattr(graph, "PAIRS_A_TASK", 10)
    cites = spark.range(60).select(F.col("id").alias("src"), (F.col("id") % 3).alias("dst"))
    got = graph.coupling(cites.unionByName(cites))
    assert got.count() == 3 * 190 and got.filter("weight <> 1 OR src_a >= src_b").count() == 0
    assert "REPARTITION_BY_NUM, " in got._jdf.queryExecution().executedPlan().toString() and ", 57)" in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_once_to_be_put_together_again(spark, sf):
    from codexlake import registry

    plan = registry.queries()["a20_inverted_abstract"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_blocks_hold_no_references_and_ties_go_by_them(spark, tmp_path):
    from codexlake.operators.fulltext import PassageIndex

    index = PassageIndex(spark, f"file://{tmp_path}/i", buckets=4)
    index.upsert(spark.range(5000).select(F.format_string("r%04d", F.lit(4999) - F.col("id")).alias("ref_id"), F.lit(0).alias("ord"), F.lit("same words").alias("text")).coalesce(1))
    index.remove(spark.createDataFrame([("r0000",), ("r4999",), ("r0063",)], "ref_id string"))
    blocks = index._read(index._state()[1], "blocks")
    assert "ref_id" not in blocks.schema.simpleString() and blocks.agg(F.sum(F.size("at"))).first()[0] == 10_000
    q = spark.createDataFrame([(1, "same"), (2, "words"), (2, "absent")], "qid int, term string")
    top = index.top(q, 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.ref_id) for r in top] == [(i, f"r000{k}") for i in (1, 2) for k in (1, 2, 3)]
    assert index.scores(q).count() == 2 * 4997


def test_bm25_once_deals_words_once_and_counts_every_text(spark):
    """Also texts without a word that a query has, and without any; two rows of one document are two texts of one document."""
    from codexlake.operators import search

    docs = spark.createDataFrame([(1, "the tide and the moon"), (2, "a b c"), (3, None), (4, "moon moon moon rock"), (5, "other things here"), (6, "tide")], "id long, text string")
    q = spark.createDataFrame([("x", "moon"), ("x", "tide"), ("x", "moon"), ("y", "the"), ("y", ""), ("z", "none")], "qid string, term string")
    got = search.bm25_once(docs, "id", "text", q)
    want = search.bm25(search.build_index(docs, "id", "text"), q)
    row = lambda df: sorted((r.qid, r.doc, round(r.score, 9), r.matched) for r in df.collect())
    assert row(got) == row(want) and len(row(got)) == 4
    # neither the words nor their texts are cut or dealt again behind what is kept
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "RepartitionByExpression" not in plan
    twice = search.bm25_once(docs.unionByName(docs.filter("id = 6")), "id", "text", q).filter("doc = 6").first()
    n, df, avgdl, tf, dl = 7, 2, 14 / 7, 2, 1
    import math

    assert twice.matched == 1 and abs(twice.score - math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) < 1e-9


def test_records_of_a_small_file_go_whole_to_no_task(spark, sf):
    """Duplicates are found and merged by shuffles, however small the file is; what the vetoes look at is not looked up again."""
    from codexlake.functions.model import as_refs
    from codexlake.operators import dedup

    p = spark.read.parquet(f"{sf}/part.parquet")
    title = F.when(F.col("p_partkey") % 5 != 0, F.concat("p_name", F.lit(" "), "p_brand"))
    refs = as_refs(p.select(F.format_string("%09d", "p_partkey").alias("id"), title.alias("title"), F.md5("p_name").alias("doi"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).alias("pmid"), F.lit(0.5).alias("completeness")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plain = dedup.veto_conflicts(dedup.veto_titles(dedup.identifier_pairs(refs, "doi"), refs, strict=False), refs, "doi")
    live, gone, moved = dedup.apply_pairs(refs, plain, ["abstract"], {"tags": (refs.select(F.col("id").alias("ref_id")), "ref_id")})
    assert not any("Broadcast" in plan(df) for df in (plain, live, gone, moved["tags"]))
    held = dedup.identifier_pairs(refs, "doi", ("title", "ref_type", "pmid", "pmcid", "arxiv_id", "isbn"))
    held = dedup.veto_conflicts(dedup.veto_titles(held, refs, strict=False), refs, "doi")
    assert plan(held).count("Join") == 1
    rows = lambda df: sorted(tuple(r) for r in df.select("keep_id", "drop_id").collect())
    assert rows(held) == rows(plain) and 0 < len(rows(held)) < dedup.identifier_pairs(refs, "doi").count()


def test_titles_of_a_pair_are_judged_as_by_their_ratios():
    import random

    from codexlake.functions import text as T

    r = random.Random(5)
    titles = [None, "", "?!", *[" ".join(r.choice(["The", "tide", "Tidés", "moon", "reef", "kelp", "2"]) for _ in range(r.randrange(1, 7))) for _ in range(60)]]
    found = set()
    for a in titles:
        for b in titles:
            x, y = T.ascii_title(a), T.ascii_title(b)
            same, fits = x != "" and y != "" and T.token_sort_ratio(x, y) >= 92, x == "" or y == "" or (T.token_set_ratio(x, y) >= 60 and T.token_sort_ratio(x, y) >= 45)
            assert T.titles_same(a, b) is same and T.titles_compatible(a, b) is fits
            found.add((same, fits))
    assert found == {(True, True), (False, True), (False, False)}
