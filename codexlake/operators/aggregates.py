"""Reports: library statistics, tiers, coverage, health, retrieval evaluation. One scan each wherever possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions.model import filled, is_complete, is_strictly_complete, tier


def library_stats(refs: DataFrame) -> DataFrame:
    """One row: n, avg_completeness, n_open_access, n_complete, n_strict, n_pdf, n_rich (completeness >= 0.8)."""
    return refs.agg(
        F.count(F.lit(1)).alias("n"), F.avg("completeness").alias("avg_completeness"), F.count_if(F.col("open_access")).alias("n_open_access"), F.count_if(is_complete()).alias("n_complete"),
        F.count_if(is_strictly_complete()).alias("n_strict"), F.count_if(filled("pdf_local") | filled("pdf_drive_id")).alias("n_pdf"), F.count_if(F.col("completeness") >= 0.8).alias("n_rich"),
    )


def counts_by(df: DataFrame, column: str | Column, name: str = "key", missing: str | None = None) -> DataFrame:
    key = F.col(column) if isinstance(column, str) else column
    if missing is not None:
        key = F.coalesce(key, F.lit(missing))
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, n: int, value: str = "n", key: str = "key") -> DataFrame:
    """The n largest, ties by key (a bounded heap a task, then one of n rows)."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(n)


def tier_histogram(refs: DataFrame) -> DataFrame:
    return counts_by(refs, tier(), "tier")


def top_authors(refs: DataFrame, n: int = 10) -> DataFrame:
    a = refs.select(F.explode("authors").alias("a"))
    key = F.concat(F.coalesce("a.family", F.lit("")), F.when(filled(F.col("a.given")), F.concat(F.lit(", "), F.substring("a.given", 1, 1), F.lit("."))).otherwise(""))
    return top(counts_by(a, key), n)


def top_words(df: DataFrame, text: str, n: int = 8, stop: Sequence[str] = ()) -> DataFrame:
    """Most frequent words of three letters and more."""
    w = df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}{3,})"))).alias("w"))
    return top(counts_by(w.filter(~F.col("w").isin(*stop)) if stop else w, "w"), n)


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """sum, max and sorted[n // 2]. The middle row's value comes from counts by value, so nothing is gathered."""
    x = df.filter(F.col(value).isNotNull())
    return x.agg(F.sum(value).alias("total"), F.max(value).alias("largest"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)").alias("upper_median"))


def decade_histogram(df: DataFrame, year: str) -> DataFrame:
    return counts_by(df.filter(F.col(year).isNotNull()), (F.floor(F.col(year) / 10) * 10).cast("int"), "decade")


def goals(df: DataFrame, updated: str, as_of: Column, done: Column) -> DataFrame:
    """Rows done since the start of the month and of the week (Monday) of as_of."""
    return df.agg(F.count_if(done & (F.col(updated) >= F.date_trunc("month", as_of))).alias("month_to_date"), F.count_if(done & (F.col(updated) >= F.date_trunc("week", as_of))).alias("week_to_date"))


def source_tiers(refs: DataFrame) -> DataFrame:
    """Where a missing file might come from, five counts in one scan."""
    missing = ~(filled("pdf_local") | filled("pdf_drive_id"))
    missing = F.coalesce(missing, F.lit(True))
    t = F.when(filled("oa_url"), "oa_url").when(filled("arxiv_id"), "arxiv").when(filled("doi"), "doi").when(filled("title"), "title").otherwise("none")
    return refs.filter(missing).agg(*[F.count_if(t == k).alias(f"n_{k}") for k in ("oa_url", "arxiv", "doi", "title", "none")])


def duplicate_groups(df: DataFrame, key: Column, id_col: str, most: int = 500) -> DataFrame:
    """key, n, smallest and largest id of keys that occur more than once; the largest groups first. Members: join df on the key."""
    g = df.filter(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).filter("n > 1")
    return g.orderBy(F.desc("n"), "key").limit(most)


def queue_rollup(queue: DataFrame, into: str) -> DataFrame:
    """Merged rows' queue entries as one: highest priority, lowest difficulty and level, most attempts, most urgent status."""
    status = F.when(F.bool_or(F.col("status") == "active"), "active").when(F.bool_or(F.col("status") == "pending"), "pending").when(F.bool_or(F.col("status") == "done"), "done").otherwise("failed")
    return queue.groupBy(into).agg(
        F.max("priority").alias("priority"), F.min("difficulty").alias("difficulty"), F.min("strategy_level").alias("strategy_level"), F.max("attempts").alias("attempts"),
        F.max("last_attempt").alias("last_attempt"), F.min("completeness_before").alias("completeness_before"), status.alias("status"),
    )


def retrieval_metrics(hits: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """hits(qid, doc, rank), expected(qid, doc, known) -> n, hit_at_1, hit_at_5, hit_at_k, mrr and classes of misses."""
    rank = expected.join(hits, ["qid", "doc"], "left").groupBy("qid").agg(F.min("rank").alias("rank"), F.bool_or("known").alias("known"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 3)
    r = F.col("rank")
    return rank.agg(
        F.count(F.lit(1)).alias("n"), share(F.coalesce(r <= 1, F.lit(False))).alias("hit_at_1"), share(F.coalesce(r <= 5, F.lit(False))).alias("hit_at_5"), share(F.coalesce(r <= k, F.lit(False))).alias("hit_at_k"),
        F.round(F.avg(F.when(r <= k, 1.0 / r).otherwise(0.0)), 3).alias("mrr"), F.count_if(~F.col("known")).alias("not_in_library"), F.count_if(F.col("known") & (r.isNull() | (r > k))).alias("missed"),
    )


def snapshot_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, delta of two reports; a key that one of them lacks counts as 0 there."""
    return before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def health(checks: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """check -> number of left rows whose key has no right row (orphans), one row a check."""
    out = None
    for name, (left, right, lk, rk) in checks.items():
        one = left.join(right.select(F.col(rk).alias("_k")).distinct(), F.col(lk) == F.col("_k"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def provider_health(calls: DataFrame) -> DataFrame:
    """calls(api, ok, fail, streak) -> api, hit rate, broken."""
    return calls.select("api", (F.col("ok") / F.nullif(F.col("ok") + F.col("fail"), F.lit(0))).alias("rate"), ((F.col("streak") >= 20) | ((F.col("ok") == 0) & (F.col("fail") >= 20))).alias("broken"))


def name_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Words seen mid-sentence in small letters at least five times and no less often than capitalised."""
    w = df.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<=[\p{L}\p{N},;] )(\p{L}{2,})"))).alias("w"))
    g = w.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w") == F.lower("w")).alias("lower"), F.count_if(F.col("w") != F.lower("w")).alias("upper"))
    return g.filter("lower >= 5 AND lower >= upper")


def merge_keywords(lists: DataFrame, key: str, keywords: str, order: str, most: int = 30) -> DataFrame:
    """Union of keyword lists by key, the first spelling of each (case ignored) kept, at most 30 of them in order."""
    k = lists.select(key, F.col(order).alias("_order"), F.posexplode(keywords).alias("_at", "word")).filter(F.trim("word") != "")
    first = k.groupBy(key, F.lower(F.trim("word")).alias("low")).agg(F.min(F.struct("_order", "_at", F.trim("word").alias("word"))).alias("f"))
    return first.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["word"]), 1, most).alias("keywords"))


def merge_sources(maps: DataFrame, key: str, sources: str) -> DataFrame:
    """Provider -> largest score over the rows of a key."""
    e = maps.select(key, F.explode(sources).alias("provider", "score")).groupBy(key, "provider").agg(F.max("score").alias("score"))
    return e.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "score")))).alias("sources"))


LOG_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)[,.]?\d*\s+\[?(\w+)\]?\s+([\w.]+)[:\s-]+(.*)$"


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Application log lines -> ts, level, logger, message; other lines are dropped."""
    part = lambda i: F.regexp_extract(column, LOG_LINE, i)
    return lines.select(F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("level"), part(3).alias("logger"), part(4).alias("message")).filter("ts IS NOT NULL")


def last_session(log: DataFrame, marker: str) -> DataFrame:
    """Log rows from the last line that holds the marker on (all rows without one)."""
    start = log.filter(F.contains("message", F.lit(marker))).agg(F.max("ts").alias("_start"))
    return log.join(F.broadcast(start)).filter("_start IS NULL OR ts >= _start").drop("_start")


# What the log says of an outcome, and a provider's share of a batch.
SAID = {"enriched": "Enriched", "requeued": "Re-queued", "save_failed": "save failed", "file_searches": "Searching PDF", "file_failures": "PDF download failed", "locked": "database is locked"}
RESOLVED = r"(\w+) batch: resolved (\d+)/(\d+)"


def session_metrics(log: DataFrame, said: dict[str, str] = SAID) -> DataFrame:
    """One row: how many messages say each of the outcomes, with the first and last time of the log. One scan, no shuffle of rows."""
    return log.agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_lines"), *[F.count_if(F.contains("message", F.lit(text))).alias(name) for name, text in said.items()])


def resolved_by_provider(log: DataFrame) -> DataFrame:
    """provider, resolved, total, rate over the log's batches."""
    part = lambda i: F.regexp_extract("message", RESOLVED, i)
    rows = log.select(part(1).alias("provider"), F.try_to_number(part(2), F.lit("9" * 18)).cast("long").alias("resolved"), F.try_to_number(part(3), F.lit("9" * 18)).cast("long").alias("total")).filter("provider <> ''")
    return rows.groupBy("provider").agg(F.sum("resolved").alias("resolved"), F.sum("total").alias("total")).withColumn("rate", F.col("resolved") / F.nullif("total", F.lit(0)))


def throughput(log: DataFrame) -> DataFrame:
    """One row from progress marks [i/n]: items from the first mark to the last, seconds between them, items a minute, days left."""
    part = lambda i: F.try_to_number(F.regexp_extract("message", r"\[(\d+)/(\d+)\]", i), F.lit("9" * 18)).cast("long")
    marks = log.select("ts", part(1).alias("at"), part(2).alias("of")).filter("at IS NOT NULL")
    first, last = F.min(F.struct("at", "ts")), F.max(F.struct("at", "ts", "of"))
    x = marks.agg(first.alias("f"), last.alias("l")).select((F.col("l.at") - F.col("f.at") + 1).alias("items"), (F.unix_timestamp("l.ts") - F.unix_timestamp("f.ts")).alias("seconds"), (F.col("l.of") - F.col("l.at")).alias("left"))
    known = (F.col("seconds") > 0) & (F.col("items") > 1)
    return x.select("items", "seconds", F.when(known, F.col("items") * 60.0 / F.col("seconds")).alias("per_minute"), F.when(known, F.col("left") * F.col("seconds") / F.col("items") / 86400.0).alias("days_left"))


def outcome_counts(attempts: DataFrame, result: str = "result", folded: Sequence[str] = ("record",), by: Sequence[str] = ()) -> DataFrame:
    """Passes by outcome; outcomes that begin with one of `folded` ('record:crossref') count under that word."""
    name = F.coalesce(result, F.lit("unknown"))
    for word in folded:
        name = F.when(F.startswith(name, F.lit(word)), F.lit(word)).otherwise(name)
    return attempts.groupBy(*by, name.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def run_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a JSON object: the first row of each part under its name (null if it is empty). Parts are reports of one row."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.first(F.struct(*df.columns)).alias(name))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out.select(F.to_json(F.struct(*parts)).alias("report"))
