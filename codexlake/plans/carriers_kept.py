"""Queries over things that are kept: an index of passages, feeds, statistics, restore points, stores."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from codexlake.operators import relational, search, vectors
from codexlake.operators.fulltext import PassageIndex, passage_search, word_passages
from codexlake.registry import query
from codexlake.sources import exchange
from codexlake.sources.library import Library
from codexlake.sources.tables import fingerprint, kept_dir, table
from codexlake.streaming import timers
from codexlake.streaming.feeds import VersionedTable
from codexlake.streaming.views import KeptCounts

SIZE = 150


def _scratch(spark, name):
    return f"{kept_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- full text ------------------------------------------------------------------------------------------------------

#: BM25 of passages of SIZE words; {documents} are the texts.
_PASSAGES = rf"""WITH d AS ({{documents}}), ps AS MATERIALIZED (SELECT doc_id AS ref_id, i AS ord, array_to_string(ws[i * {SIZE} + 1 : i * {SIZE} + {SIZE}], ' ') AS text
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM d), unnest(range(0, (len(ws) + {SIZE - 1}) // {SIZE})) AS r(i)),
tok AS MATERIALIZED (SELECT ref_id, ord, list_filter(regexp_extract_all(lower(text), '[\p{{{{L}}}}\p{{{{N}}}}_\-]+'), lambda w: length(w) > 1) AS ws FROM ps),
p AS MATERIALIZED (SELECT ref_id, ord, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT ref_id, ord, len(ws) AS dl, unnest(ws) AS term FROM tok) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tok), q AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{{{L}}}}\p{{{{N}}}}_\-]+'), lambda w: length(w) > 1)) AS term FROM benchmark),
s AS (SELECT qid, ref_id, ord, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ref_id, ord) AS rank FROM s)
"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(search.tokens(F.col("text"))).alias("term"))


def kept_index(spark, sf_dir) -> PassageIndex:
    """The index of the documents' passages; it is built once for a state of the table's files."""
    docs = table(spark, sf_dir, "documents")
    index = PassageIndex(spark, f"{kept_dir(spark)}/passage-windows-{fingerprint(docs)}")
    if not index.manifest.newest()[0]:
        index.upsert(word_passages(docs.select("doc_id", "text"), "doc_id", "text", SIZE))
    return index


@query("i07_passage_search", _PASSAGES.format(documents="SELECT doc_id, text FROM documents") + """, v AS (SELECT a.vec_id AS qid, b.vec_id AS ref_id, 0 AS ord, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
    FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b),
f AS (SELECT qid, ref_id, ord, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT qid, ref_id, ord, rank FROM r UNION ALL SELECT qid, ref_id, ord, rank FROM v) WHERE rank <= 50 GROUP BY 1, 2, 3),
c AS (SELECT *, row_number() OVER (PARTITION BY qid, ref_id ORDER BY score DESC, ord) AS k FROM f)
SELECT qid, ref_id, ord, score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ref_id, ord) AS place FROM c WHERE k <= 2) WHERE place <= 8""")
def fused_passages(spark, sf_dir):
    """All questions against the kept index, fused with a dense ranking of the documents' first passages."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "qid")
    dense = vectors.top_for_queries(e, asked, 50).select("qid", F.col("vec_id").alias("ref_id"), F.lit(0).alias("ord"), "rank")
    return passage_search(kept_index(spark, sf_dir), _questions(spark, sf_dir), dense=dense)


@query("b15_b16_kept_index", _PASSAGES.format(documents="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new words of ' || doc_id ELSE text END AS text FROM documents WHERE doc_id % 7 <> 1") + "SELECT qid, ref_id, ord, rank FROM r WHERE rank <= 20")
def maintained_index(spark, sf_dir):
    """An index of the old texts after a third of them has changed and a seventh has gone: the best twenty passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = PassageIndex(spark, _scratch(spark, "maintained"))
    index.upsert(word_passages(docs, "doc_id", "text", SIZE))
    changed = docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new words of "), F.col("doc_id").cast("string")))
    index.upsert(word_passages(changed, "doc_id", "text", SIZE))
    index.remove(docs.filter("doc_id % 7 = 1").select(F.col("doc_id").alias("ref_id")))
    return index.top(_questions(spark, sf_dir), 20).select("qid", "ref_id", "ord", "rank")


# ---- state with timers ----------------------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a stream cannot read a single file by its name


@query("m05_lapsed_leases", """SELECT user_id::VARCHAR AS key, ts + INTERVAL 10 MINUTE AS at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, max(ts) OVER () AS last FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
    WHERE event_type = 'click' AND CASE WHEN next IS NULL THEN epoch_ms(ts) + 600000 <= epoch_ms(last) ELSE next >= ts + INTERVAL 10 MINUTE END""")
def lapsed_leases(spark, sf_dir):
    """A click takes a user's entry, any other event ends the work on it: entries that were given back after ten minutes."""
    rows = timers.as_rows(_event_stream(spark, sf_dir), "user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "take").otherwise("done"))
    return timers.replayed(timers.lapses(rows, timers.Leases()), _scratch(spark, "leases")).select("key", F.col("at").cast("timestamp_ntz").alias("at"))


@query("m09_cooldown_ends", """WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, max(ts) OVER () AS last, sum((event_type IS DISTINCT FROM 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS errors FROM e WHERE bad),
u AS (SELECT *, max(ts + to_seconds(least(300, 15 * 2 ** least(errors, 5))::INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS until, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM n)
SELECT user_id::VARCHAR AS key, until AS at FROM u WHERE CASE WHEN next IS NULL THEN epoch_ms(until) <= epoch_ms(last) ELSE next >= until END""")
def cooldown_ends(spark, sf_dir):
    """Each user a service: errors make it pause, longer after each in a row; the moments at which pauses ended."""
    rows = timers.as_rows(_event_stream(spark, sf_dir), "user_id", "ts", "event_id", F.coalesce(F.col("event_type"), F.lit("")))
    return timers.replayed(timers.lapses(rows, timers.Cooldowns()), _scratch(spark, "cooldowns")).select("key", F.col("at").cast("timestamp_ntz").alias("at"))


# ---- kept statistics, restore points --------------------------------------------------------------------------------

_ORDERS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 11 <> 3)"


@query("m14_kept_statistics", f"SELECT status, count(*) AS n, round(sum(price), 2)::DOUBLE AS sum_price, round(avg(price), 4) AS avg_price FROM {_ORDERS} GROUP BY 1")
def kept_statistics(spark, sf_dir):
    """Statistics of the orders, counted once and then changed by two versions: a fifth is replaced, an eleventh goes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    orders = VersionedTable(spark, _scratch(spark, "orders"))
    view = KeptCounts(orders, _scratch(spark, "order-counts"), {"status": F.col("status")}, {"price": F.col("price")})
    orders.apply(o.withColumn("batch_seq", F.lit(1)), log=True)
    view.refresh()
    orders.apply(o.filter("id % 5 = 0").withColumns({"status": F.lit("X"), "price": F.col("price") + 100, "batch_seq": F.lit(1)}), log=True)
    orders.apply(o.limit(0).withColumn("batch_seq", F.lit(1)), removed=o.filter("id % 11 = 3"), log=True)
    assert view.refresh()[1] == 2
    return view.read().select("status", "n", F.round(F.col("sum_price").cast("double"), 2).alias("sum_price"), F.round("avg_price", 4).alias("avg_price"))


@query("b18_restore_points", """WITH p AS (SELECT 'archived' AS moment, o_orderkey % 7 = 2 AS gone, o_orderkey FROM orders UNION ALL SELECT 'restored', false, o_orderkey FROM orders)
SELECT moment, 'refs' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM p WHERE NOT gone GROUP BY 1 UNION ALL SELECT moment, 'archive', count(*) FILTER (WHERE gone), coalesce(sum(o_orderkey) FILTER (WHERE gone), 0)::BIGINT FROM p GROUP BY 1
UNION ALL SELECT moment, 'bridge', count(*), sum(l_orderkey)::BIGINT FROM p JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT gone GROUP BY 1""")
def restore_points(spark, sf_dir):
    """A seventh of the records is archived with its bridge rows, all in one commit; then the point before is restored."""
    library = Library(spark, _scratch(spark, "library"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    bridge = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref_id"), "l_partkey")
    empty = refs.limit(0).withColumns({"archive_rule": F.lit(""), "archived_at": F.lit("")})
    library.commit({"refs": refs, "bridge": bridge, "archive": empty})
    library.mark("before")
    ids = library.read("refs").filter("id % 7 = 2").select("id")
    live, archived = relational.archive(library.read("refs"), library.read("archive"), ids, "seventh", "2024-01-01")
    left = relational.delete(library.read("refs"), ids, "id", [(library.read("bridge"), "ref_id")])[1]
    then = library.commit({"refs": live, "archive": archived, "bridge": left})
    now = library.restore("before")
    total = lambda number, moment, name, key: library.read(name, number).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(key), F.lit(0)).alias("keys")).select(F.lit(moment).alias("moment"), F.lit(name).alias("name"), "n", "keys")
    parts = [total(number, moment, name, key) for number, moment in ((then, "archived"), (now, "restored")) for name, key in (("refs", "id"), ("archive", "id"), ("bridge", "ref_id"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---- exchange with a service ----------------------------------------------------------------------------------------


@query("a24_b14_push_and_pull", "SELECT o_orderkey AS version, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'PATCH' ELSE 'POST' END AS method FROM orders WHERE o_orderkey > 500 AND o_orderkey <= 2500")
def push_and_pull(spark, sf_dir):
    """Orders are pushed as pages in the order of their version (the same push twice, which counts once), and pulled since a version."""
    exchange.register(spark)
    path = _scratch(spark, "exchange")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "PATCH").otherwise("POST").alias("method"))
    for _ in range(2):
        rows.repartitionByRange("version").sortWithinPartitions("version").write.format("page_exchange").option("path", path).option("push", "orders").mode("append").save()
    pulled = spark.read.format("page_exchange").schema("version long, status string, method string").option("path", path).load()
    return pulled.filter("version > 500 AND version <= 2500")
