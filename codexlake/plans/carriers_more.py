"""More carrier queries: joins with vetoes, reports, orders, identifiers, pairwise scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexlake.functions import scalar
from codexlake.functions import text as T
from codexlake.operators import aggregates as A
from codexlake.operators import matching, relational, windows
from codexlake.registry import query
from codexlake.sources.tables import table


@query("a02_a18_json_lines", "SELECT event_id, (props::JSON->>'$.k')::INT AS k FROM events")
def json_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int").alias("r")).select("event_id", "r.k")


@query("a19_payload_mapping", "SELECT p_partkey, lower('10.1/' || p_partkey) AS doi, p_name AS title, (1990 + p_size)::INT AS year FROM part")
def payload_mapping(spark, sf_dir):
    """Parts as provider answers, mapped back to records."""
    from codexlake.sources.readers import parse_payloads

    p = table(spark, sf_dir, "part")
    answer = F.to_json(F.struct(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("DOI"), F.array("p_name").alias("title"), F.struct(F.array(F.array(F.lit(1990) + F.col("p_size"))).alias("date-parts")).alias("issued")))
    r = parse_payloads(p.select(answer.alias("payload")), "crossref")
    return r.select(F.regexp_extract("doi", r"/(\d+)$", 1).cast("long").alias("p_partkey"), "doi", "title", "year")


@query("a25_log_lines", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, upper(event_type) AS level FROM events")
def log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper("event_type"), F.lit(" app.events: "), F.col("event_id").cast("string"))
    return A.log_lines(e.select(line.alias("value"))).select(F.col("message").cast("long").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "level")


@query("b03_replace_conflicts", "SELECT a.c_custkey AS id, b.c_custkey AS other FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 5 = 0")
def replace_conflicts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("doi"))
    nxt = c.select((F.col("id") - 1).alias("id"), "doi").filter("id % 5 = 0 AND id >= 0")
    return relational.replace_unless_taken(c, nxt)[1].select("id", "other")


@query("b09_markdown_lines", "SELECT c_custkey, '## ' || c_name AS head FROM customer")
def markdown_lines(spark, sf_dir):
    from codexlake.functions.model import as_refs
    from codexlake.sources.writers import markdown

    r = as_refs(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title")))
    return r.select(F.col("id").cast("long").alias("c_custkey"), F.split_part(markdown(), F.lit("\n"), F.lit(1)).alias("head"))


@query("b08_ris_titles", "SELECT p_partkey, 'TI  - ' || p_name AS line FROM part")
def ris_titles(spark, sf_dir):
    from codexlake.functions.model import as_refs
    from codexlake.sources.writers import ris

    r = as_refs(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title")))
    return r.select(F.col("id").cast("long").alias("p_partkey"), F.regexp_extract(ris(), r"(?m)^(TI  - .*)$", 1).alias("line"))


@query("c18_relevance", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'mail[0-9]') AND NOT regexp_matches(text, 'token')")
def relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("mail[0-9]") & ~F.col("text").rlike("token")).select("doc_id")


@query("c19_filtered_similarity", "SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id = 3) a, embeddings b WHERE b.vec_id <> 3 AND b.label < 3 ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 10")
def filtered_similarity(spark, sf_dir):
    from codexlake.operators.vectors import top_similar

    e = table(spark, sf_dir, "embeddings")
    return top_similar(e, e.filter("vec_id = 3"), 10, condition=F.col("label") < 3).select("vec_id", F.round("score", 6).alias("score"))


@query("d19_local_candidates")
def local_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi"), F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("isbn"), F.col("p_name").alias("title"))
    return matching.local_candidates(p.withColumnRenamed("id", "seed_id"), p)


@query("d25_resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("d28_new_or_changed", "SELECT page_id FROM pages WHERE NOT (page_id % 4 = 0 AND length(html) % 2 = 0)")
def new_or_changed(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("size"), F.col("page_id").alias("mtime"))
    log = p.filter("page_id % 4 = 0").withColumn("size", F.when(F.col("size") % 2 == 0, F.col("size")).otherwise(F.col("size") + 1))
    return relational.new_or_changed(p, log).select("page_id")


@query("e06_queue_status", "SELECT event_type AS status, count(*) AS n, sum(user_id)::BIGINT AS attempts FROM events GROUP BY 1")
def queue_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("attempts"))


@query("e15_e16_rollup", "SELECT o_custkey, max(o_totalprice) AS priority, min(o_orderkey) AS difficulty, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'active' WHEN bool_or(o_orderstatus = 'O') THEN 'pending' ELSE 'done' END AS status FROM orders GROUP BY 1")
def rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "active").when(F.col("o_orderstatus") == "O", "pending").otherwise("done")
    q = o.select("o_custkey", F.col("o_totalprice").alias("priority"), F.col("o_orderkey").alias("difficulty"), F.lit(0).alias("strategy_level"), F.lit(0).alias("attempts"), F.col("o_orderdate").alias("last_attempt"), F.lit(0.0).alias("completeness_before"), status.alias("status"))
    return A.queue_rollup(q, "o_custkey").select("o_custkey", "priority", "difficulty", "status")


@query("e19_coverage", "SELECT lang || ':' || source AS key, count(*) AS n FROM documents GROUP BY 1")
def coverage(spark, sf_dir):
    return A.counts_by(table(spark, sf_dir, "documents"), F.concat("lang", F.lit(":"), "source"))


@query("e28_provider_health", "SELECT event_type AS api, (count(*) FILTER (WHERE value > 50))::DOUBLE / count(*) AS rate, count(*) FILTER (WHERE value > 50) = 0 AND count(*) >= 20 AS broken FROM events GROUP BY 1")
def provider_health(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("api")).agg(F.count_if(F.col("value") > 50).alias("ok"), F.count_if(~(F.col("value") > 50)).alias("fail")).withColumn("streak", F.lit(0))
    return A.provider_health(e)


@query("e30_success_rates", "SELECT user_id, count(*) AS tried, count(*) FILTER (WHERE event_type = 'purchase') AS found FROM events GROUP BY 1")
def success_rates(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("tried"), F.count_if(F.col("event_type") == "purchase").alias("found"))


@query("f06_first_relevant", "SELECT o_custkey, min(rk)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE o_orderstatus = 'F' GROUP BY 1")
def first_relevant(spark, sf_dir):
    r = table(spark, sf_dir, "orders").withColumn("rk", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return r.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("rk").alias("rank"))


@query("f07_last_session", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_type = 'signup')")
def last_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("message"))
    return A.last_session(e, "signup").select("event_id")


@query("g03_status_order", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 40")
def status_order(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@query("g06_copies", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_partkey) AS rn FROM part) WHERE rn <= 6")
def copies(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return windows.capped_per_group(p, "p_brand", [F.when(F.col("p_size") > 25, 0).otherwise(1), F.col("p_partkey")], 6).select("p_brand", "p_partkey")


@query("g08_severity", "SELECT CASE WHEN n >= 20 THEN 'certain' WHEN n >= 10 THEN 'likely' ELSE 'possible' END AS label, count(*) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def severity(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"))
    return A.counts_by(g, F.when(F.col("c") >= 20, "certain").when(F.col("c") >= 10, "likely").otherwise("possible"), "label")


@query("g12_keep_first", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1")
def keep_first(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("h04_entry_hash", "SELECT p_partkey, substr(sha1('10.1/' || p_partkey || '||||||' || lower(p_name) || '|' || (1990 + p_size)), 1, 16) AS hash FROM part".replace("'||||||'", "'|||||'"))
def entry_hash(spark, sf_dir):
    from codexlake.functions.model import as_refs

    p = table(spark, sf_dir, "part")
    r = as_refs(p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size")).alias("year")))
    return r.select(F.col("id").cast("long").alias("p_partkey"), scalar.entry_hash().alias("hash"))


@query("h16_author_parts", "SELECT s_suppkey, split_part(s_name, '#', 2) AS family, split_part(s_name, '#', 1) AS given FROM supplier")
def author_parts(spark, sf_dir):
    a = scalar.parse_author(F.concat(F.split_part("s_name", F.lit("#"), F.lit(2)), F.lit(", "), F.split_part("s_name", F.lit("#"), F.lit(1))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", a.alias("a")).select("s_suppkey", "a.family", "a.given")


@query("h18_citation", "SELECT c_custkey, c_mktsegment || ' (n.d.). ' || c_name AS cite FROM customer")
def citation(spark, sf_dir):
    from codexlake.functions.model import PERSON, as_refs

    none = F.lit(None).cast("string")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.array(F.struct(F.col("c_mktsegment").alias("family"), none.alias("given"), none.alias("orcid"), none.alias("affiliation"))).cast(f"array<{PERSON}>").alias("authors"))
    return as_refs(c).select(F.col("id").cast("long").alias("c_custkey"), scalar.citation().alias("cite"))


@query("h27_check_digits", "SELECT p_partkey, (9*10 + 9*9 + 2*8 + 1*7 + 5*6 + 8*5 + 1*4 + 0*3 + (p_partkey % 10)*2 + (p_partkey // 10 % 10)) % 11 = 0 AS ok FROM part")
def check_digits(spark, sf_dir):
    s = F.concat(F.lit("99215810"), (F.col("p_partkey") % 10).cast("string"), F.floor(F.col("p_partkey") / 10).cast("long") % 10)
    return table(spark, sf_dir, "part").select("p_partkey", scalar.isbn_ok(s).alias("ok"))


@query("j01_token_sort")
def token_sort(spark, sf_dir):
    """Every benchmark text against the next one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    x = b.toDF("a", "ta").join(b.select((F.col("item_id") - 1).alias("a"), F.col("text").alias("tb")), "a")
    return x.select("a", F.round(T.udf_token_sort()("ta", "tb"), 6).alias("sort_ratio"), F.round(T.udf_token_set()("ta", "tb"), 6).alias("set_ratio"), T.udf_titles_agree()("ta", "tb").alias("agree"))


_LONG_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 2))"


@query("j09_title_on_page", f"SELECT b.item_id, d.doc_id FROM (SELECT item_id, {_LONG_WORDS} AS q FROM benchmark) b JOIN (SELECT doc_id, {_LONG_WORDS} AS w FROM documents) d ON len(list_intersect(b.q, d.w)) >= greatest(2, ceil(len(b.q) * 0.6))")
def title_on_page(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.titles_on_pages(b.toDF("title_id", "title"), d.toDF("page_id", "page")).toDF("item_id", "doc_id")


@query("k05_duplicate_report", "SELECT 'possible' AS label, 'title' AS rule, lower(trim(t)) AS key, count(*) AS n FROM (SELECT split_part(text, chr(10), 1) AS t FROM documents) WHERE trim(t) <> '' GROUP BY 3 HAVING count(*) > 1")
def duplicate_report(spark, sf_dir):
    from codexlake.functions.model import as_refs
    from codexlake.operators.dedup import duplicate_report as report

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return report(as_refs(d))


@query("m03_enqueue", "SELECT c_custkey, round_even(greatest(0::DOUBLE, 1 - c_acctbal / 10000) * 0.05, 3) AS priority, 4 AS strategy_level FROM customer")
def enqueue(spark, sf_dir):
    from codexlake.functions.model import as_refs

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_acctbal") / 10000).alias("completeness"), F.lit("short").alias("title"))
    return as_refs(c).select(F.col("id").cast("long").alias("c_custkey"), scalar.enrich_priority().alias("p")).select("c_custkey", "p.priority", "p.strategy_level")


@query("m11_next_backend", "SELECT event_type AS backend FROM (SELECT event_type, count(*) FILTER (WHERE value < 50) AS r, count(*) AS a FROM events GROUP BY 1) ORDER BY r::DOUBLE / a DESC, event_type LIMIT 1")
def next_backend(spark, sf_dir):
    from codexlake.streaming.feeds import next_backend as pick

    return pick(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("backend")).agg(F.count_if(F.col("value") < 50).alias("remaining"), F.count(F.lit(1)).alias("allowance")))


@query("m13_live_cache", "SELECT user_id AS key, max_by(event_id, ts) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1")
def live_cache(spark, sf_dir):
    from codexlake.streaming.feeds import live_cache as live

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return live(e, "2024-01-31").select("key", "event_id")


@query("n01_tag_rules", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'steel') AND p_size BETWEEN 5 AND 40")
def tag_rules(spark, sf_dir):
    from codexlake.functions.model import as_refs
    from codexlake.operators.tagging import TagRule, auto_tags

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"))
    tagged = auto_tags(as_refs(p), [TagRule(["metal"], keywords=["Steel"], year_from=5, year_to=40)])
    return tagged.filter(F.array_contains("tags", "metal")).select(F.col("id").cast("long").alias("p_partkey"))


@query("n04_suggested_tags", r"SELECT doc_id AS id, w AS tag FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS rn FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_\-]+')) AS w FROM documents) JOIN (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS t FROM benchmark) ON t = w)) WHERE rn <= 10")
def suggested(spark, sf_dir):
    from codexlake.operators.tagging import suggest_tags

    tags = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name"))
    return suggest_tags(table(spark, sf_dir, "documents"), tags, F.col("text"), id_col="doc_id")
