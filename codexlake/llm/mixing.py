"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Targets: every source gets the budget in proportion to its weight; what exceeds max_epochs times its size is clamped
and shared again among the others by weight until nothing exceeds. Sorted by cap / weight, the clamped sources are a
prefix, so the fixed point of that repetition is read off with two running sums over the sources.

Sampling: a source's target is so many whole repetitions of all its documents and a fractional one, which takes
documents in the order of a seeded hash up to the missing number of words. The place where it stops is found by
descending the hash by two hexadecimal digits at a time (256 sums a source and level), so a hot source never meets in
one task and the words taken miss the target by at most half a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.llm.common import WORD_GAP, written

GAPS = " \t\n\x0b\f\r"
#: Levels of two hexadecimal digits that narrow down where a source's fractional repetition stops.
LEVELS = 3


def word_count(text):
    """Number of words of a text column (null: 0)."""
    trimmed = F.btrim(text, F.lit(GAPS))
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sizes(source, size) -> source, source_size, target: one row per source (null is one, the last).

    Weights repeat over the sources in code point order. The tables here have a row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(names) - 1) % len(weights)
    weight = F.lit(None).cast("double")
    for i, w in enumerate(weights):
        weight = F.when(turn == i, F.lit(float(w))).otherwise(weight)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onwards = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    per = per.withColumn("level", level).withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)["level"]
    per = per.withColumn("water", water)
    return per.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, copies, taken; a row per input row.

    size: words of the text (null and empty: 0, which takes part without effect). copies: whole repetitions plus one
    where the fractional repetition takes the row; taken = size * copies. Ties in the hash (repeated rows) go by
    doc_id, then size, so reruns agree; rows without a doc_id go by their text. A null source is a source. Weights must be
    positive. Columns named in carry go along (for joins by a row's key); other columns are ignored; an empty table
    gives an empty result.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.col("text").cast("string"))), F.lit(""))))
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), mark.alias("u"), *carry), "mix-sizes")
    targets = source_targets(sized, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("edge", F.lit(""))
    state = written(state, "mix-state")
    for k in range(LEVELS):
        here = sized.alias("d").join(state.alias("s"), F.expr("d.source <=> s.source AND substr(d.u, 1, %d) = s.edge" % (2 * k)))
        sums = here.groupBy(F.col("d.source").alias("source"), F.substring("d.u", 2 * k + 1, 2).alias("digit")).agg(F.sum("d.size").alias("words"))
        order = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        start = sums.select("source", "digit", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("start"))
        last = start.alias("b").join(state.alias("s"), F.expr("b.source <=> s.source AND b.start <= s.left"))
        last = last.groupBy(F.col("b.source").alias("at_source")).agg(F.max(F.struct(F.col("b.digit").alias("digit"), F.col("b.start").alias("start"))).alias("at"))
        state = written(
            state.join(last, F.expr("source <=> at_source"), "left").select("source", "source_size", "target", "whole", (F.col("left") - F.coalesce(F.col("at.start"), F.lit(0))).alias("left"), F.concat("edge", F.coalesce(F.col("at.digit"), F.lit(""))).alias("edge")),
            "mix-state",
        )
    rows = sized.alias("d").join(state.alias("s"), F.expr("d.source <=> s.source")).select("d.doc_id", "d.source", "d.size", "d.u", "s.source_size", "s.target", "s.whole", "s.left", "s.edge", *[f"d.{c}" for c in carry])
    at_edge = F.substring("u", 1, 2 * LEVELS) == F.col("edge")
    order = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter(at_edge).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("extra", (F.col("before") + F.col("size") / 2.0 <= F.col("left")).cast("long")).drop("before")
    rest = rows.filter(~at_edge).withColumn("extra", (F.substring("u", 1, 2 * LEVELS) < F.col("edge")).cast("long"))
    both = edge.unionByName(rest).withColumn("copies", F.col("whole") + F.col("extra"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *carry)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, weight, cap, (SELECT level FROM l WHERE cap / weight > level ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS water FROM l),
u AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM t),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM u),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS need,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before + size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
