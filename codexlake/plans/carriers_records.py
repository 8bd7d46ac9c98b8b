"""Queries over a library of records: every one goes through the library's operator, the oracle states its rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexlake.functions import scalar
from codexlake.functions.model import as_refs
from codexlake.operators import aggregates as A
from codexlake.operators import backfill, dedup, graph, matching, relational, search
from codexlake.plans.carriers_passes import LIB, _library, _works
from codexlake.registry import query
from codexlake.sources import writers
from codexlake.sources.tables import spread, table


def _key():
    return F.col("id").cast("long")


# ---- scans, sinks, filters ------------------------------------------------------------------------------------------


@query("a04_multi_get", "SELECT c_custkey, c_name FROM (VALUES (9), (3), (777777777), (5)) v(k) JOIN customer ON c_custkey = k")
def multi_get(spark, sf_dir):
    return relational.in_given_order(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", [9, 3, 777777777, 5])


@query("b02_bulk_upsert", LIB + """SELECT id, doi, CASE WHEN id % 6 = 0 AND doi IS NOT NULL THEN 'new' ELSE title END AS title FROM lib UNION ALL SELECT id + 1000000000, NULL, 'new' FROM lib WHERE id % 6 = 0 AND doi IS NULL""")
def bulk_upsert(spark, sf_dir):
    """Rows under new ids: those with a DOI that a record has go to that record."""
    base = _library(spark, sf_dir).select("id", "doi", "title")
    batch = base.filter(_key() % 6 == 0).select((_key() + 1000000000).cast("string").alias("id"), "doi", F.lit("new").alias("title"), _key().alias("batch_seq"))
    return relational.upsert(base, batch, keep=()).select(_key().alias("id"), "doi", "title")


@query("b12_csv_fields", LIB + "SELECT id, CASE WHEN has_authors THEN segment || ', Ann' END AS authors, round(completeness * 100)::BIGINT || '%' AS completeness FROM lib WHERE completeness >= 0")
def csv_fields(spark, sf_dir):
    return writers.flat(_library(spark, sf_dir).filter("completeness >= 0")).select(_key().alias("id"), "authors", "completeness")


@query("b22_file_names", "SELECT p_partkey AS id, 'Bell_' || (1990 + p_size) || '_work_' || p_partkey || '_on_' || split_part(p_name, ' ', 1) AS file FROM part")
def file_names(spark, sf_dir):
    return _works(spark, sf_dir).select(_key().alias("id"), scalar.file_name().alias("file"))


@query("c05_e08_tier_histogram", LIB + "SELECT CASE WHEN doi IS NOT NULL OR arxiv_id IS NOT NULL THEN 1 WHEN oa_url IS NOT NULL THEN 2 WHEN title IS NOT NULL AND year IS NOT NULL THEN 3 WHEN title IS NOT NULL THEN 4 ELSE 5 END AS tier, count(*) AS n FROM lib GROUP BY 1")
def tiers(spark, sf_dir):
    return A.tier_histogram(_library(spark, sf_dir))


@query("c12_n09_saved_search", LIB + "SELECT id FROM lib WHERE year >= 1995 AND pdf_local IS NULL AND completeness BETWEEN 0.2 AND 0.8 AND title IS NOT NULL AND has_authors")
def saved_search(spark, sf_dir):
    filters = {"year_from": 1995, "has_pdf": False, "completeness": (0.2, 0.8), "query": "Customer", "author": "ann"}
    return backfill.saved_search(_library(spark, sf_dir), filters).select(_key().alias("id"))


@query("c15_e13_source_tiers", LIB + """SELECT count(*) FILTER (t = 1) AS n_oa_url, count(*) FILTER (t = 2) AS n_arxiv, count(*) FILTER (t = 3) AS n_doi, count(*) FILTER (t = 4) AS n_title, count(*) FILTER (t = 5) AS n_none
FROM (SELECT CASE WHEN oa_url IS NOT NULL THEN 1 WHEN arxiv_id IS NOT NULL THEN 2 WHEN doi IS NOT NULL THEN 3 WHEN title IS NOT NULL THEN 4 ELSE 5 END AS t FROM lib WHERE pdf_local IS NULL)""")
def source_tiers(spark, sf_dir):
    return A.source_tiers(_library(spark, sf_dir))


# ---- reports and keys -----------------------------------------------------------------------------------------------


@query("e01_e18_metrics", LIB + """SELECT count(*) AS n, round(avg(completeness), 6) AS avg_completeness, 0 AS n_open_access, count(*) FILTER (title IS NOT NULL AND has_authors AND (doi IS NOT NULL OR arxiv_id IS NOT NULL OR oa_url IS NOT NULL OR pdf_local IS NOT NULL)) AS n_complete,
count(*) FILTER (title IS NOT NULL AND has_authors AND publisher IS NOT NULL AND year IS NOT NULL AND doi IS NOT NULL) AS n_strict, count(pdf_local) AS n_pdf, count(*) FILTER (completeness >= 0.8) AS n_rich FROM lib""")
def metrics(spark, sf_dir):
    return A.library_stats(_library(spark, sf_dir)).withColumn("avg_completeness", F.round("avg_completeness", 6))


@query("e24_name_vocabulary", r"""WITH t AS (SELECT string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL), p AS (SELECT unnest(list_zip(ws[1:len(ws) - 1], ws[2:])) AS z FROM t),
w AS (SELECT regexp_extract(z[2], '^\p{L}{2,}') AS w FROM p WHERE regexp_matches(z[1], '[\p{L}\p{N},;]$'))
SELECT lower(w) AS word, count(*) FILTER (w = lower(w)) AS lower, count(*) FILTER (w <> lower(w)) AS upper FROM w WHERE w <> '' GROUP BY 1 HAVING count(*) FILTER (w = lower(w)) >= 5 AND count(*) FILTER (w = lower(w)) >= count(*) FILTER (w <> lower(w))""")
def vocabulary(spark, sf_dir):
    return A.name_vocabulary(table(spark, sf_dir, "documents"), "text")


@query("h02_hash_key", LIB + """SELECT id, substr(sha256(CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN arxiv_id IS NOT NULL THEN 'arxiv:' || arxiv_id
ELSE 'title:' || lower(coalesce(title, '')) || ':' || coalesce(year::VARCHAR, '') || ':' || CASE WHEN has_authors THEN lower(segment) ELSE '' END || ':' END), 1, 24) AS ref_id FROM lib""")
def hash_key(spark, sf_dir):
    return _library(spark, sf_dir).select(_key().alias("id"), scalar.ref_id().alias("ref_id"))


@query("h07_clean_doi", "SELECT p_partkey, '10.1000/abc' || p_partkey AS doi FROM part")
def clean_doi(spark, sf_dir):
    raw = F.concat(F.lit(" https://dx.doi.org/10.1000/AbC"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, "?from=x#y").otherwise(")."))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.clean_doi(raw).alias("doi"))


@query("h14_ids_in_url", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '10.1000/x' || p_partkey END AS doi, CASE WHEN p_size % 2 = 1 THEN '2001.' || (10000 + p_partkey) END AS arxiv_id FROM part")
def ids_in_url(spark, sf_dir):
    """Addresses behind two redirects."""
    key = F.col("p_partkey").cast("string")
    inner = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/x"), key)).otherwise(F.concat(F.lit("https://arxiv.org/abs/2001."), (F.col("p_partkey") + 10000).cast("string")))
    wrapped = F.concat(F.lit("https://a.org/r?url="), F.url_encode(F.concat(F.lit("https://b.org/go?target="), F.url_encode(inner))))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", scalar.ids_in_url(scalar.unwrap_url(wrapped)).alias("x")).select("p_partkey", "x.doi", "x.arxiv_id")


@query("h17_author_text", LIB + "SELECT id, CASE WHEN has_authors THEN 'Ann ' || segment END AS people FROM lib")
def author_text(spark, sf_dir):
    return _library(spark, sf_dir).select(_key().alias("id"), scalar.author_text().alias("people"))


@query("h24_priority", LIB + """SELECT id, round_even(greatest(0::DOUBLE, 1 - completeness) * CASE l WHEN 0 THEN 10 WHEN 4 THEN 0.05 ELSE 1 END::DOUBLE, 3) AS priority, CASE l WHEN 0 THEN 0 WHEN 4 THEN 3 ELSE 1 END AS difficulty, l AS strategy_level
FROM (SELECT *, CASE WHEN doi IS NOT NULL OR arxiv_id IS NOT NULL THEN 0 WHEN title IS NOT NULL AND (year IS NOT NULL OR has_authors) THEN 2 WHEN title IS NOT NULL THEN 3 ELSE 4 END AS l FROM lib)""")
def priority(spark, sf_dir):
    refs = _library(spark, sf_dir).withColumn("title", F.replace("title", F.lit("#"), F.lit(" ")))
    return refs.select(_key().alias("id"), scalar.enrich_priority().alias("p")).select("id", "p.*")


# ---- search ---------------------------------------------------------------------------------------------------------

_TERMS = r"SELECT item_id AS doc, unnest(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_\-]+'), lambda w: length(w) > 1)) AS term FROM benchmark"


@query("i03_all_prefixes", f"WITH t AS ({_TERMS.format('text')}) SELECT doc FROM t GROUP BY 1 HAVING bool_or(starts_with(term, 'the')) AND bool_or(starts_with(term, 'rea'))")
def all_prefixes(spark, sf_dir):
    index = search.build_index(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return search.search_all_prefixes(index, ["The", "rea"]).select("doc")


@query("b15_b16_patched_index", "WITH t AS (" + _TERMS.format("CASE WHEN item_id % 3 = 0 THEN 'new words of ' || item_id ELSE text END") + ") SELECT term, count(DISTINCT doc) AS df FROM t GROUP BY 1")
def patched_index(spark, sf_dir):
    """An index of the old texts, mended by the third of them that changed."""
    old = table(spark, sf_dir, "benchmark").select("item_id", "text")
    new = old.withColumn("text", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("new words of "), F.col("item_id").cast("string"))).otherwise(F.col("text")))
    return search.patch_index(search.build_index(old, "item_id", "text"), new.filter("item_id % 3 = 0"), new, "item_id", "text").terms


# ---- duplicates -----------------------------------------------------------------------------------------------------


def _next_pairs(refs):
    return refs.select(F.col("id").alias("keep_id"), (_key() + 1).cast("string").alias("drop_id"))


@query("d09_d10_conflicting_pairs", LIB + "SELECT a.id AS keep_id, b.id AS drop_id FROM lib a JOIN lib b ON b.id = a.id + 1 WHERE (a.doi IS NULL OR b.doi IS NULL) AND (a.arxiv_id IS NULL OR b.arxiv_id IS NULL)")
def conflicting_pairs(spark, sf_dir):
    refs = _library(spark, sf_dir)
    return dedup.veto_conflicts(_next_pairs(refs), refs).select(F.col("keep_id").cast("long"), F.col("drop_id").cast("long"))


@query("d11_fill_from_twin", LIB + """, k AS (SELECT nation, min(id) AS keep_id FROM lib GROUP BY 1), q AS (SELECT k.keep_id, lib.*, (-((CASE WHEN doi IS NOT NULL THEN 60 ELSE 0 END + CASE WHEN title IS NOT NULL THEN 20 ELSE 0 END
+ CASE WHEN has_authors THEN 15 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 10 ELSE 0 END) + completeness * 10), id::VARCHAR) AS o FROM k JOIN lib USING (nation) WHERE id <> keep_id)
SELECT keep_id, min_by(title, o) FILTER (title IS NOT NULL) AS title, min_by(publisher, o) FILTER (publisher IS NOT NULL) AS publisher, min_by(year, o) FILTER (year IS NOT NULL) AS year FROM q GROUP BY 1""")
def fill_from_twin(spark, sf_dir):
    """The smallest customer of a nation stands for the others."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("id"))
    keep = c.groupBy("c_nationkey").agg(F.min("id").alias("keep"))
    pairs = c.join(keep, "c_nationkey").filter("id <> keep").select(F.col("keep").cast("string").alias("keep_id"), F.col("id").cast("string").alias("drop_id"))
    return dedup.fill_plan(pairs, _library(spark, sf_dir), ["title", "publisher", "year"]).withColumn("keep_id", F.col("keep_id").cast("long"))


def _kinds(spark, sf_dir):
    """Parts as records whose titles are equal or wholly different (hashes of their names)."""
    kind = F.when(F.col("p_size") % 2 == 0, "book").otherwise("book-chapter")
    return as_refs(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.md5("p_name").alias("title"), (F.col("p_size") + 1990).alias("year"), kind.alias("ref_type")))


@query("d22_guarded_collisions", """SELECT k AS keep_id, p.p_partkey AS drop_id FROM part p JOIN (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1) USING (p_brand) JOIN part h ON h.p_partkey = k
WHERE k <> p.p_partkey AND p.p_name = h.p_name AND abs(p.p_size - h.p_size) <= 3""")
def guarded_collisions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    first = p.groupBy("p_brand").agg(F.min("p_partkey").cast("string").alias("other"))
    merges = dedup.collision_merges(p.join(first.hint("shuffle_hash"), "p_brand").select(F.col("p_partkey").cast("string").alias("id"), "other"), _kinds(spark, sf_dir))
    return merges.select(F.col("keep_id").cast("long"), F.col("drop_id").cast("long"))


@query("k07_strict_veto", "SELECT a.p_partkey AS keep_id, b.p_partkey AS drop_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_name = b.p_name AND a.p_size % 2 = b.p_size % 2")
def strict_veto(spark, sf_dir):
    refs = _kinds(spark, sf_dir)
    return dedup.veto_titles(_next_pairs(refs), refs, strict=True).select(F.col("keep_id").cast("long"), F.col("drop_id").cast("long"))


@query("k04_overrides", LIB + "SELECT id, CASE WHEN id % 3 = 0 THEN 'by hand' ELSE title END AS title, publisher FROM lib")
def overrides(spark, sf_dir):
    from codexlake.operators.fusion import with_overrides

    refs = _library(spark, sf_dir).select("id", "title", "publisher")
    chosen = refs.filter(_key() % 3 == 0).select("id", F.lit("by hand").alias("title"), F.lit(None).cast("string").alias("publisher"))
    return with_overrides(refs, chosen).withColumn("id", _key())


@query("k13_fill_empty", LIB + "SELECT id, coalesce(publisher, 'Press') AS publisher, coalesce(year, 2001) AS year FROM lib")
def fill_empty(spark, sf_dir):
    refs = _library(spark, sf_dir).select("id", "publisher", "year")
    return matching.fill_empty(refs, refs.select("id", F.lit("Press").alias("publisher"), F.lit(2001).alias("year")), ["publisher", "year"]).withColumn("id", _key())


@query("k14_ingest_outcome", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'skipped' WHEN p_size % 3 = 0 AND p_size % 5 = 0 THEN 'exists' WHEN p_size % 3 = 0 THEN 'attached' WHEN p_size % 7 = 0 THEN 'created' ELSE 'created_unresolved' END AS outcome FROM part")
def ingest_outcome(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", matching.ingest_outcome(s % 2 != 0, F.when(s % 3 == 0, F.col("p_partkey")), s % 5 == 0, s % 7 == 0).alias("outcome"))


# ---- graph, notes, paths --------------------------------------------------------------------------------------------


@query("l01_edges", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def edges(spark, sf_dir):
    works = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ref_id")).agg(F.collect_list("l_partkey").alias("referenced_works"))
    return graph.edges_of(works)


@query("l01_lookup_status", LIB + "SELECT id, CASE WHEN doi IS NULL THEN 'no_doi' WHEN id % 6 = 0 THEN 'error' WHEN id % 2 = 0 THEN 'ok' ELSE 'not_found' END AS status FROM lib")
def lookup_status(spark, sf_dir):
    refs = _library(spark, sf_dir).select(_key().alias("ref_id"), "doi")
    answers = refs.filter("ref_id % 2 = 0").select("ref_id", F.when(F.col("ref_id") % 6 == 0, "timeout").alias("error"))
    return graph.lookup_status(refs, answers).withColumnRenamed("ref_id", "id")


@query("l04_backfill_outcomes", LIB + "SELECT CASE WHEN id % 5 = 0 THEN 'memory' WHEN doi IS NULL THEN 'unmatched' WHEN id % 4 = 1 THEN 'no note' ELSE 'doi' END AS result, count(*) AS n FROM lib GROUP BY 1")
def backfill_outcomes(spark, sf_dir):
    refs = _library(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    entries = refs.select(F.upper("doi").alias("doi"), nothing.alias("arxiv_id"), nothing.alias("title"), F.when(_key() % 5 == 0, "memory").alias("level"), F.when(_key() % 4 != 1, F.concat(F.lit("note "), "id")).alias("note"))
    existing = spark.createDataFrame([], "project string, ref_id string, claim string")
    return backfill.backfill_notes(entries, refs, existing, "p")[1]


@query("d27_repair_paths", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'moved' ELSE 'stale' END AS outcome, CASE p_partkey % 3 WHEN 0 THEN '/a/F' || p_partkey || '.pdf' WHEN 1 THEN '/b/f' || p_partkey || '.PDF' END AS new_path FROM part")
def repair_paths(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    refs = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("/a/F"), key, F.lit(".pdf")).alias("pdf_path"))
    files = p.filter("p_partkey % 3 < 2").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/a/F"), key, F.lit(".pdf"))).otherwise(F.concat(F.lit("/b/f"), key, F.lit(".PDF"))).alias("path"))
    return relational.repair_paths(refs, files).select("id", "outcome", "new_path")


# ---- queue ----------------------------------------------------------------------------------------------------------


@query("m05_dequeue", LIB + "SELECT id FROM lib WHERE (doi IS NOT NULL OR arxiv_id IS NOT NULL) AND id % 5 <> 0 ORDER BY CASE WHEN completeness BETWEEN 0.6 AND 0.8 THEN 0 ELSE 1 END, completeness DESC, id::VARCHAR LIMIT 60")
def dequeue(spark, sf_dir):
    from codexlake.streaming.queue import dequeue as take

    refs = _library(spark, sf_dir)
    queue = refs.select(F.col("id").alias("ref_id"), F.when(_key() % 5 == 0, "done").otherwise("pending").alias("status"), F.lit(0).alias("strategy_level"), F.col("completeness").alias("priority"), F.col("completeness").alias("completeness_before"))
    return take(queue, refs, 1, 60).select(F.col("ref_id").cast("long").alias("id"))


@query("m06_route_result", LIB + "SELECT id, CASE WHEN id % 5 = 0 AND doi IS NULL THEN 0 WHEN id % 5 = 1 THEN 1 WHEN id % 5 = 2 AND year IS NULL THEN 2 WHEN id % 5 = 3 OR title IS NULL THEN 4 ELSE 3 END AS level FROM lib")
def route_result(spark, sf_dir):
    from codexlake.streaming.queue import route_result as route

    before = _library(spark, sf_dir)
    turn = _key() % 5
    after = before.withColumns({
        "doi": F.when(turn == 0, F.coalesce("doi", F.lit("10.2/9"))).otherwise(F.col("doi")), "url": F.when(turn == 1, "http://a.org"),
        "year": F.when(turn == 2, F.coalesce("year", F.lit(2000))).otherwise(F.col("year")), "title": F.when(turn == 3, "Untitled").otherwise(F.col("title")),
    })
    return route(before, after).withColumn("id", _key())


@query("m09_cooldowns", "SELECT p_partkey, least(300.0, 15.0 * power(2, least(p_size % 9, 5)))::DOUBLE AS seconds, least(12.0, power(2, p_size % 7))::DOUBLE AS hours FROM part")
def cooldowns(spark, sf_dir):
    from codexlake.streaming.feeds import cooldown_seconds, strike_hours

    return table(spark, sf_dir, "part").select("p_partkey", cooldown_seconds(F.col("p_size") % 9).alias("seconds"), strike_hours(F.col("p_size") % 7 + 1).alias("hours"))
