"""Queries of the repair, resolution, backfill and report operators, and round trips of readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexlake.functions import repair
from codexlake.functions.model import PERSON, TYPE_OF_BASE, as_refs, lookup
from codexlake.operators import aggregates as A
from codexlake.operators import backfill, matching, relational, resolution, search, wordsplit
from codexlake.registry import query
from codexlake.sources import readers, tables, writers
from codexlake.sources.tables import table

# One library of records for the queries below: customers as works. The oracles state the same fields.
LIB = """WITH lib AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN '10.1/' || c_custkey END AS doi, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS title, c_custkey % 5 <> 0 AS has_authors,
CASE WHEN c_custkey % 7 <> 0 THEN 1990 + c_nationkey END AS year, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN c_mktsegment END AS publisher, c_acctbal / 10000 AS completeness,
CASE WHEN c_custkey % 6 = 0 THEN 'http://a.org/' || c_custkey END AS oa_url, CASE WHEN c_nationkey = 4 THEN '2001.' || (10000 + c_custkey) END AS arxiv_id, CASE WHEN c_custkey % 9 = 0 THEN 'x.pdf' END AS pdf_local, c_mktsegment AS segment, c_nationkey AS nation FROM customer)
"""


def _library(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text, nation = key.cast("string"), F.col("c_nationkey")
    person = F.array(F.struct(F.col("c_mktsegment").alias("family"), F.lit("Ann").alias("given"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("affiliation")))
    return as_refs(c.select(
        text.alias("id"), F.when(nation % 3 == 0, F.concat(F.lit("10.1/"), text)).alias("doi"), F.when(key % 4 != 0, F.col("c_name")).alias("title"), F.when(key % 5 != 0, person).alias("authors"),
        F.when(key % 7 != 0, nation + 1990).alias("year"), F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), F.col("c_mktsegment")).alias("publisher"), (F.col("c_acctbal") / 10000).alias("completeness"),
        F.when(key % 6 == 0, F.concat(F.lit("http://a.org/"), text)).alias("oa_url"), F.when(nation == 4, F.concat(F.lit("2001."), (key + 10000).cast("string"))).alias("arxiv_id"), F.when(key % 9 == 0, "x.pdf").alias("pdf_local"),
        F.concat(F.lit('{"shelf":"'), F.col("c_mktsegment"), F.lit('"}')).alias("extras"),
    ))


# ---- scans, orders, updates -----------------------------------------------------------------------------------------


@query("a26_attached", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def attached(spark, sf_dir):
    customer, nation = tables.attach(spark, sf_dir, ["customer", "nation"], "other")
    return spark.sql(f"SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1")


@query("b05_integration_ids", """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END AS pdf_path, CASE WHEN c_custkey % 3 = 0 THEN '{"shelf":"' || c_mktsegment || '","page":"' || c_custkey || '"}' ELSE '{"shelf":"' || c_mktsegment || '"}' END AS extras FROM customer""")
def integration_ids(spark, sf_dir):
    refs = _library(spark, sf_dir)
    key = F.col("id")
    patch = refs.filter(key.cast("long") % 3 == 0).select("id", F.concat(F.lit("p"), key).alias("pdf_path"), F.concat(F.lit('{"page":"'), key, F.lit('"}')).alias("extras"))
    return relational.set_integration_ids(refs, patch).select(key.cast("long").alias("id"), "pdf_path", "extras")


@query("b19_run_report", """SELECT '{"orders":{"n":' || (SELECT count(*) FROM orders) || ',"open":' || (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') || '},"events":{"n":' || (SELECT count(*) FROM events) || '}}' AS report""")
def run_report(spark, sf_dir):
    n = F.count(F.lit(1)).alias("n")
    return A.run_report({"orders": table(spark, sf_dir, "orders").agg(n, F.count_if(F.col("o_orderstatus") == "O").alias("open")), "events": table(spark, sf_dir, "events").agg(n)})


@query("c11_within_collection", "SELECT doc_id FROM documents WHERE lang = 'en' AND (contains(lower(split_part(text, chr(10), 1)), 'there') OR contains(lower(source), 'src1'))")
def within_collection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    people = F.array(F.struct(F.col("source").alias("family"), *[F.lit(None).cast("string").alias(n) for n in ("given", "orcid", "affiliation")]))
    refs = d.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), people.alias("authors"))
    members = d.select(F.col("doc_id").alias("ref_id"), F.col("lang").alias("collection_id"))
    found = [relational.within_collection(refs, members, "en", text, "doc_id").select("doc_id") for text in ("There", "SRC1")]
    return found[0].unionByName(found[1]).distinct()


@query("g05_metadata_candidates", LIB + """SELECT id FROM (SELECT *, coalesce(title, '') <> '' AND has_authors AND publisher IS NOT NULL AND year IS NOT NULL AS whole FROM lib) WHERE doi IS NOT NULL AND (NOT whole OR oa_url IS NULL)
ORDER BY CASE WHEN title IS NOT NULL AND has_authors AND year IS NOT NULL AND publisher IS NULL THEN 1 WHEN NOT whole THEN 2 ELSE 3 END, completeness DESC, year DESC NULLS LAST, id::VARCHAR LIMIT 100""")
def metadata_candidates(spark, sf_dir):
    return backfill.metadata_candidates(_library(spark, sf_dir), 100).select(F.col("id").cast("long").alias("id"))


@query("g05_file_candidates", LIB + """SELECT id FROM lib WHERE pdf_local IS NULL AND (arxiv_id IS NOT NULL OR oa_url IS NOT NULL OR doi IS NOT NULL) AND id % 4 <> 0
ORDER BY CASE WHEN arxiv_id IS NOT NULL THEN 1 WHEN oa_url IS NOT NULL THEN 2 ELSE 3 END, year DESC NULLS LAST, id::VARCHAR LIMIT 100""")
def file_candidates(spark, sf_dir):
    """A quarter of the records missed as they are, one as it was before, one was found, one was never tried."""
    from codexlake.functions.scalar import entry_hash

    refs = _library(spark, sf_dir)
    turn = F.col("id").cast("long") % 4
    tried = refs.filter(turn < 3).select(F.col("id").alias("ref_id"), F.lit("pdf").alias("api"), F.when(turn == 1, "before").otherwise(entry_hash()).alias("entry_hash"), F.when(turn == 2, "ok").otherwise("miss").alias("result"))
    return backfill.file_candidates(refs, tried, 100).select(F.col("id").cast("long").alias("id"))


@query("g07_shuffled", "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 400")
def shuffled(spark, sf_dir):
    return relational.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 400, seed=7)


@query("i08_notes_search", r"""WITH tok AS (SELECT conv_id * 1000 + turn AS id, role, turn, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]+'), lambda w: length(w) > 1) AS ws FROM conversations),
p AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM tok) WHERE term IN ('thereof', 'tion', 'whether', 'reed', 'and') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tok),
s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))) AS score FROM p JOIN df USING (term) JOIN tok USING (id), st GROUP BY 1)
SELECT id, round(score, 6) AS score FROM s JOIN tok USING (id) WHERE role = 'user' AND turn % 4 <> 2 ORDER BY round(s.score, 9) DESC, id LIMIT 50""")
def notes_search(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("project"), F.when(F.col("turn") % 4 == 2, "superseded").otherwise("active").alias("status"), F.col("text").alias("claim"))
    return search.search_notes(notes, "Whether reed, tion thereof and", 50, project="user").select("id", F.round("score", 6).alias("score"))


# ---- logs and outcomes ----------------------------------------------------------------------------------------------


def _log(spark, sf_dir):
    """Events as lines of an application log, read back by the log reader."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    message = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("Enriched record "), n)).when(F.col("event_type") == "error", "save failed: timeout").when(F.col("event_type") == "signup", F.concat(F.lit("Re-queued "), n))
        .when(F.col("event_type") == "click", F.concat(F.when(F.col("user_id") % 2 == 0, "OpenAlex").otherwise("CrossRef"), F.lit(" batch: resolved "), (F.col("event_id") % 41).cast("string"), F.lit("/50"))).otherwise(F.concat(F.lit("checked ["), n, F.lit("/9000000]")))
    )
    return A.log_lines(e.select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 INFO lake.daemon: "), message).alias("value")))


@query("e27_session_metrics", "SELECT date_trunc('second', min(ts)) AS began, date_trunc('second', max(ts)) AS ended, count(*) AS n_lines, count(*) FILTER (event_type = 'purchase') AS enriched, count(*) FILTER (event_type = 'signup') AS requeued, count(*) FILTER (event_type = 'error') AS save_failed FROM events")
def session_metrics(spark, sf_dir):
    x = A.session_metrics(_log(spark, sf_dir))
    return x.select(F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n_lines", "enriched", "requeued", "save_failed")


@query("e27_resolved_by_provider", "SELECT CASE WHEN user_id % 2 = 0 THEN 'OpenAlex' ELSE 'CrossRef' END AS provider, sum(event_id % 41)::BIGINT AS resolved, 50 * count(*) AS total, round(sum(event_id % 41) / (50.0 * count(*)), 9) AS rate FROM events WHERE event_type = 'click' GROUP BY 1")
def resolved_by_provider(spark, sf_dir):
    return A.resolved_by_provider(_log(spark, sf_dir)).select("provider", "resolved", "total", F.round("rate", 9).alias("rate"))


@query("e27_throughput", """WITH v AS (SELECT event_id AS k, epoch(date_trunc('second', ts))::BIGINT AS s FROM events WHERE event_type = 'view'), x AS (SELECT max(k) - min(k) + 1 AS items, arg_max(s, k) - arg_min(s, k) AS seconds, 9000000 - max(k) AS left_ FROM v)
SELECT items, seconds, round(items * 60.0 / seconds, 6) AS per_minute, round(left_ * seconds::DOUBLE / items / 86400.0, 6) AS days_left FROM x""")
def throughput(spark, sf_dir):
    return A.throughput(_log(spark, sf_dir)).select("items", "seconds", F.round("per_minute", 6).alias("per_minute"), F.round("days_left", 6).alias("days_left"))


@query("e21_outcome_counts", "SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE event_type || ':' || (event_id % 3) END AS result, count(*) AS n FROM events GROUP BY 1, 2")
def outcome_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.lit(":"), (F.col("event_id") % 3).cast("string")).alias("result"))
    return A.outcome_counts(e, folded=("click", "view"), by=("user_id",))


# ---- repair ---------------------------------------------------------------------------------------------------------


@query("h13_bare_title", "SELECT p_partkey, 'Uber ' || p_name || ' a study' AS title FROM part")
def bare_title(spark, sf_dir):
    made = F.concat(F.lit("(No. 1) Über "), F.col("p_name"), F.lit(", a study | "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", repair.udf_bare_title()(made).alias("title"))


@query("h19_type_codes", "SELECT p_partkey, CASE p_size WHEN 11 THEN 'book' WHEN 13 THEN 'conference-paper' WHEN 14 THEN 'report' WHEN 18 THEN 'thesis' WHEN 19 THEN 'preprint' WHEN 7 THEN 'dataset' ELSE 'unknown' END AS ref_type FROM part")
def type_codes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lookup(TYPE_OF_BASE, F.col("p_size").cast("string"), "unknown").alias("ref_type"))


@query("h22_understand", """SELECT p_partkey, p_name || ' is suf' || 'ficient' AS title, CASE p_partkey % 3 WHEN 0 THEN 'Lecture Notes in Computer Science' WHEN 1 THEN 'Lecture Notes in Logic' END AS series, CASE WHEN p_partkey % 3 < 2 THEN p_size::VARCHAR END AS volume FROM part""")
def understand(spark, sf_dir):
    size, turn = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    head = F.when(turn == 0, F.concat(F.lit("LNCS "), size, F.lit(": "))).when(turn == 1, F.concat(F.lit("Lecture Notes in Logic vol. "), size, F.lit(", "))).otherwise("")
    u = repair.understand(F.concat(head, F.lit("{\\bf "), F.col("p_name"), F.lit("} is <i>suf ficient</i>")))
    return tables.spread(table(spark, sf_dir, "part")).select("p_partkey", u.alias("u")).select("p_partkey", "u.*")


@query("h25_cleaner_twin", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'The ' || p_name ELSE 'Shop | The ' || p_name END AS title FROM part")
def cleaner_twin(spark, sf_dir):
    whole, clean = F.concat(F.lit("Shop | The "), F.col("p_name")), F.concat(F.lit("The "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", repair.cleaner_twin(whole, F.array(F.lit("The"), F.when(F.col("p_size") % 2 == 0, clean))).alias("title"))


@query("h30_parse_note", "SELECT p_partkey, p_name AS title, 1990 + p_size AS year, 'Bell, ' || p_type AS authors FROM part")
def parse_note(spark, sf_dir):
    note = F.concat(F.col("p_name"), F.lit(" / Ann Bell; "), F.col("p_type"), F.lit(" / "), (F.col("p_size") + 1990).cast("string"))
    x = table(spark, sf_dir, "part").select("p_partkey", repair.parse_note(note).alias("n"))
    return x.select("p_partkey", "n.title", "n.year", F.array_join(F.transform("n.authors", lambda a: a["family"]), ", ").alias("authors"))


@query("h31_readable", "SELECT p_partkey, p_name || ' ' || p_type || ' ' || (1990 + p_size) AS title, 1990 + p_size AS year, 'Annals of ' || p_type AS journal FROM part")
def readable(spark, sf_dir):
    year = (F.col("p_size") + 1990).cast("string")
    file = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")), F.lit("_"), F.col("p_type"), year, F.lit(".pdf"))
    hints = repair.folder_hints(F.concat(F.lit("/lib/Annals of "), F.col("p_type"), F.lit("/"), year, F.lit("/"), file))
    return table(spark, sf_dir, "part").select("p_partkey", repair.readable(file).alias("title"), hints.alias("h")).select("p_partkey", "title", "h.*")


@query("h31_glued_words")
def glued_words(spark, sf_dir):
    """Names and types of parts as files glue them, split by the words of documents and parts. No SQL: tested against all cuts."""
    p = table(spark, sf_dir, "part").withColumn("title", F.concat_ws(" ", "p_name", F.lower("p_type")))
    costs = wordsplit.word_costs(table(spark, sf_dir, "documents").select("text").unionByName(p.select(F.col("title").alias("text"))), "text")
    glued = p.select("p_partkey", F.initcap(F.replace(F.lower("title"), F.lit(" "), F.lit(""))).alias("title"))
    return wordsplit.split_glued(glued, "p_partkey", "title", costs)


@query("h32_clean_seed", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_name END AS title, CASE WHEN p_size * 100 BETWEEN 1400 AND 2026 THEN p_size * 100 END AS year, CASE WHEN length(hex(p_partkey * 1000003)) >= 6 THEN 1 ELSE 2 END AS n_authors FROM part")
def clean_seed(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    people = F.transform(F.array(F.hex(F.col("p_partkey") * 1000003), F.lit("Bell")), lambda f: F.named_struct(F.lit("family"), f, F.lit("given"), F.lit(None).cast("string"), F.lit("orcid"), F.lit(None).cast("string"), F.lit("affiliation"), F.lit(None).cast("string")))
    refs = as_refs(p.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 5 == 0, "Untitled").otherwise(F.col("p_name")).alias("title"), (F.col("p_size") * 100).alias("year"), people.alias("authors")))
    return repair.clean_seed(refs, F.lit(2025)).select(F.col("id").cast("long").alias("p_partkey"), "title", "year", F.size("authors").alias("n_authors"))


# ---- resolution -----------------------------------------------------------------------------------------------------


@query("a23_best_hits", "SELECT p_partkey AS ref_id, 'https://doi.org/10.1/' || p_partkey AS url, 'two' AS backend FROM part WHERE p_size % 4 <> 0")
def best_hits(spark, sf_dir):
    """Three hits a record: two with the title, of which the DOI address is the better one, and another work's."""
    p = tables.spread(table(spark, sf_dir, "part"))
    key, title = F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(" of the "), "p_type")
    refs = p.select(F.col("p_partkey").alias("id"), title.alias("title"), F.array().cast("array<string>").alias("surnames"), F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("int").alias("year"))
    hit = lambda name, t, url: p.select(F.col("p_partkey").alias("ref_id"), F.lit(name).alias("backend"), t.alias("title"), url.alias("url"), F.lit("").alias("snippet"), "p_size")
    hits = hit("one", title, F.concat(F.lit("http://a.org/"), key)).unionByName(hit("two", title, F.concat(F.lit("https://doi.org/10.1/"), key))).filter("p_size % 4 <> 0")
    return matching.best_hits(refs, hits.unionByName(hit("three", F.lit("Wholly other matters"), F.concat(F.lit("http://b.org/"), key)))).select("ref_id", "url", "backend")


@query("j07_damaged_titles")
def damaged_titles(spark, sf_dir):
    """First lines of documents, whole, cut in the middle, against the line itself and that of the document after it. No SQL: a fitted model over sequence ratios."""
    works = tables.spread(table(spark, sf_dir, "documents")).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    side = lambda df, s, t: df.select("doc_id", t.alias(f"{s}_title"), F.array(F.lit("Ann Bell")).alias(f"{s}_authors"), F.lit(2000).alias(f"{s}_year"), F.lit("journal-article").alias(f"{s}_kind"))
    seeds = side(works, "seed", F.expr("left(title, length(title) div 2)"))
    same = side(works, "cand", F.col("title"))
    after = same.withColumn("doc_id", F.col("doc_id") - 1)
    pairs = seeds.join(same, "doc_id").withColumn("same", F.lit(True)).unionByName(seeds.join(after, "doc_id").withColumn("same", F.lit(False)))
    return resolution.judge_pairs(pairs).select("doc_id", "same", F.round("p", 6).alias("p"), "veto", "verdict")


@query("j08_books", "SELECT p_partkey AS seed_id, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS pos, '978' || p_partkey AS isbn FROM part WHERE p_size % 3 <> 0 AND 1985 + p_size % 30 <= 2001")
def books(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    seeds = p.select(F.col("p_partkey").alias("seed_id"), F.concat(F.lit("A complete guide to the "), F.col("p_name")).alias("title"), F.lit("smith").alias("surname"), F.lit(2000).alias("year"))
    right, isbn = F.concat(F.lit("Complete Guide to "), F.col("p_name"), F.lit(": an introduction")), F.concat(F.lit("978"), F.col("p_partkey").cast("string"))
    names = F.array(F.when(F.col("p_size") % 3 == 0, "Eve Jones").otherwise("John Smith"))
    row = lambda pos, title, code: p.select(F.col("p_partkey").alias("seed_id"), F.lit(pos).alias("pos"), title.alias("title"), names.alias("names"), (F.col("p_size") % 30 + 1985).alias("first_year"), F.lit(None).cast("int").alias("year"), code.alias("isbn"))
    volumes = row(0, F.lit("Cooking for beginners and others"), isbn).unionByName(row(1, right, F.when(F.col("p_size") % 2 == 0, isbn))).unionByName(row(2, right, isbn))
    return resolution.pick_books(seeds, volumes)


# ---- round trips ----------------------------------------------------------------------------------------------------

_WORKS = "SELECT 'work ' || p_partkey || ' on ' || p_name AS title, 1990 + p_size AS year, '10.1000/' || p_partkey AS doi, 'Bell' AS family, 'Ann' AS given, p_type AS publisher FROM part"


def _works(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    person = F.array(F.from_json(F.lit('{"family":"Bell","given":"Ann"}'), PERSON))
    return as_refs(tables.spread(table(spark, sf_dir, "part")).select(
        key.alias("id"), F.concat(F.lit("work "), key, F.lit(" on "), "p_name").alias("title"), (F.col("p_size") + 1990).alias("year"), F.concat(F.lit("10.1000/"), key).alias("doi"),
        person.alias("authors"), F.col("p_type").alias("publisher"), F.lit("book").alias("ref_type"),
    ))


def _round_trip(spark, sf_dir, fmt):
    text = _works(spark, sf_dir).select(writers.FORMATS[fmt]().alias("value"))
    r = readers.parse_texts(text, fmt)
    return r.select("title", "year", "doi", F.get("authors", F.lit(0))["family"].alias("family"), F.get("authors", F.lit(0))["given"].alias("given"), "publisher")


@query("a07_b07_bibtex_round_trip", _WORKS)
def bibtex_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "bibtex")


@query("a08_b08_ris_round_trip", _WORKS)
def ris_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "ris")


@query("a09_b11_json_round_trip", _WORKS)
def json_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json")


@query("b10_rdf_titles", "SELECT 'https://doi.org/10.1000/' || p_partkey AS uri, 'work ' || p_partkey || ' on ' || p_name AS title, 'Bell' AS surname FROM part")
def rdf_titles(spark, sf_dir):
    """Items of the RDF export, read back by XPath."""
    x = _works(spark, sf_dir).select(writers.zotero_rdf().alias("x")).select(F.regexp_replace("x", r"(</?|\s)[a-z]+:", "$1").alias("x"))
    return x.select(F.xpath_string("x", F.lit("/*/@about")).alias("uri"), F.xpath_string("x", F.lit("//title")).alias("title"), F.xpath_string("x", F.lit("//surname")).alias("surname"))


@query("a11_bookmarks", "SELECT 'http://a.org/' || p_brand AS url, count(DISTINCT p_brand) AS n FROM part GROUP BY 1")
def bookmarks(spark, sf_dir):
    """A bookmark file a brand, with one address as often as the brand has parts; an address counts once a file."""
    link = F.concat(F.lit('<DT><A HREF="http://a.org/'), F.col("p_brand"), F.lit('">'), F.col("p_name"), F.lit("</A>\n"))
    files = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(link), "").alias("body"))
    value = F.concat(F.lit("<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<DL><p>\n"), F.col("body"), F.lit("</DL><p>\n"))
    return readers.parse_texts(files.select(value.alias("value")), "bookmarks").groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("b13_notes_document", """WITH t AS (SELECT DISTINCT role, turn FROM conversations) SELECT role AS project, '# ' || role || chr(10) || chr(10) || string_agg(CASE WHEN EXISTS (SELECT 1 FROM t u WHERE u.role = t.role AND u.turn = t.turn + 2) THEN '- ~~turn ' || turn || '~~' ELSE '- turn ' || turn END, chr(10) ORDER BY turn) AS document FROM t GROUP BY 1""")
def notes_document(spark, sf_dir):
    """One document a role: its turns as notes, every one followed by a later turn superseded by it."""
    c = table(spark, sf_dir, "conversations").select("role", "turn").distinct()
    notes = c.select(F.col("role").alias("project"), (F.col("turn") * 10 + F.length("role")).alias("note_id"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("claim"), F.lit(None).cast("string").alias("quote"), F.when(F.col("turn") >= 2, (F.col("turn") - 2) * 10 + F.length("role")).alias("supersedes"))
    return writers.notes_document(notes).withColumnRenamed("value", "document")


# ---- the record -----------------------------------------------------------------------------------------------------


@query("h01_completeness", LIB + """SELECT id, round_even(least(1.0, CASE WHEN title IS NOT NULL THEN 0.22 + 0.12 ELSE 0 END + CASE WHEN has_authors THEN 0.15 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 0.10 ELSE 0 END
+ CASE WHEN doi IS NOT NULL OR arxiv_id IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN publisher IS NOT NULL THEN 0.08 ELSE 0 END)::DOUBLE, 4) AS completeness FROM lib""")
def completeness(spark, sf_dir):
    from codexlake.functions import model

    return _library(spark, sf_dir).select(F.col("id").cast("long").alias("id"), model.completeness().alias("completeness"))


@query("c01_scan", LIB + "SELECT id FROM lib WHERE year >= 1995 AND year <= 2005")
def scan(spark, sf_dir):
    return relational.scan(_library(spark, sf_dir), year_from=1995, year_to=2005).select(F.col("id").cast("long").alias("id"))


@query("f02_quality_score", LIB + "SELECT id, round(CASE WHEN doi IS NOT NULL THEN 60 ELSE 0 END + CASE WHEN title IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN has_authors THEN 15 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 10 ELSE 0 END + completeness * 10, 6) AS score FROM lib")
def quality_score(spark, sf_dir):
    from codexlake.functions.scalar import quality_score as score

    return _library(spark, sf_dir).select(F.col("id").cast("long").alias("id"), F.round(score(), 6).alias("score"))


@query("h29_citations", "SELECT p_partkey AS id, 'Bell, A. (' || (1990 + p_size) || '). work ' || p_partkey || ' on ' || p_name || '. ' AS head FROM part")
def citations(spark, sf_dir):
    from codexlake.functions.scalar import cite_apa

    return _works(spark, sf_dir).select(F.col("id").cast("long").alias("id"), F.regexp_extract(cite_apa(), r"^(Bell, A\. \(\d+\)\. [^.]*\. )", 1).alias("head"))


@query("k06_dedup_all", "SELECT min(p_partkey)::BIGINT AS id, count(*) AS n FROM part GROUP BY p_name || ' of the ' || p_brand || ' kind', p_size")
def dedup_driver(spark, sf_dir):
    """Parts as records, those of one name, brand and size under one ISBN; every group ends in its smallest id."""
    from codexlake.operators.dedup import dedup_all

    p = tables.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    title = F.concat("p_name", F.lit(" of the "), "p_brand", F.lit(" kind"))
    refs = as_refs(p.select(F.format_string("%09d", "p_partkey").alias("id"), title.alias("title"), F.concat(F.lit("10.1/"), F.sha1(F.concat_ws("|", title, F.col("p_size").cast("string")))).alias("doi"), F.lit("book").alias("ref_type"), F.lit(0.5).alias("completeness"), F.lit("2020-01-01").cast("timestamp").alias("created_at")))
    live, gone = dedup_all(refs, ["abstract"])
    lost = gone.groupBy(F.col("merged_into").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    return live.join(lost, "id", "left").select(F.col("id").cast("long").alias("id"), (F.coalesce("m", F.lit(0)) + 1).alias("n"))
