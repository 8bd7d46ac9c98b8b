"""Glued words ('Diamondsintherough') split by the cheapest segmentation over the words of a corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters from which a word counts as glued; known words are shorter, so a glued word never vouches for itself.
GLUED = 16
#: Bits are counted in thousandths, so costs are whole numbers and sums do not depend on an order.
PER_BIT = 1000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def is_glued(word: Column, least: int = GLUED) -> Column:
    """A long word of letters, all small but perhaps the first."""
    return (F.length(word) >= least) & word.rlike(r"^\p{L}\p{Ll}+$")


def word_costs(texts: DataFrame, column: str, least: int = GLUED) -> DataFrame:
    """texts -> word, cost: what each known word costs, the negative logarithm of its share in the texts.

    Known are lower-case runs of 2 to least - 1 letters and 'a' and 'i'. Null and empty texts have none; without any the
    result is empty.
    """
    found = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}]+")).alias("word"))
    counts = found.filter((F.length("word") < least) & ((F.length("word") > 1) | F.col("word").isin("a", "i"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select("word", F.round(F.log2(F.lit(total) / F.col("n")) * PER_BIT).cast("long").alias("cost"))


def cheapest(n: int, edges: list[tuple[int, int, int]]) -> list[int]:
    """Lengths of the parts of a word of n letters, from edges (start, length, cost); [] if they do not cover it.

    Of equal costs the fewest parts win, then the longer first part.
    """
    best: list[tuple[int, int, int] | None] = [None] * n + [(0, 0, 0)]  # from here on: cost, parts, first part's length, negative
    for start, length, cost in sorted(edges, reverse=True):
        after = best[start + length]
        if after is not None:
            here = (cost + after[0], after[1] + 1, -length)
            if best[start] is None or here < best[start]:
                best[start] = here
    out, at = [], 0
    while at < n and best[at] is not None:
        out.append(-best[at][2])
        at += out[-1]
    return out


def udf_cheapest():
    @F.pandas_udf("array<int>")
    def run(n: pd.Series, starts: pd.Series, lengths: pd.Series, costs: pd.Series) -> pd.Series:
        return pd.Series([cheapest(m, list(zip(s.tolist(), k.tolist(), c.tolist()))) for m, s, k, c in zip(n, starts, lengths, costs)])

    return run


def glued_parts(glued: DataFrame, costs: DataFrame, least: int = GLUED) -> DataFrame:
    """glued(word), costs(word, cost) -> word, parts: the parts of each distinct word that known words cover, two or more.

    A word's stretches of less than `least` letters meet the known words in an equi-join, so neither side is broadcast
    and a row holds at most `least` stretches a letter.
    """
    words = glued.select("word").distinct()
    cut = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start")).select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(least - 1), F.length("word") - F.col("start")))).alias("length"))
    cut = cut.withColumn("part", F.lower(F.expr("substring(word, start + 1, length)")))
    known = cut.join(costs.withColumnRenamed("word", "part"), "part").groupBy("word").agg(F.collect_list(F.struct("start", "length", "cost")).alias("edges"))
    found = known.withColumn("lengths", udf_cheapest()(F.length("word"), F.col("edges.start"), F.col("edges.length"), F.col("edges.cost"))).filter(F.size("lengths") > 1)
    ends = found.withColumn("ends", F.transform("lengths", lambda _, i: F.aggregate(F.slice("lengths", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)))
    return ends.select("word", F.expr("transform(lengths, (n, i) -> substring(word, ends[i] - n + 1, n))").alias("parts"))


def split_glued(texts: DataFrame, key: str, column: str, costs: DataFrame, least: int = GLUED) -> DataFrame:
    """texts with glued words of a column split and white space between words as one space; other columns stay.

    `key` tells rows apart (rows that share one get the same splits). Null texts stay null; words that known words do not
    cover, or cover best in one part, stay whole.
    """
    glued = texts.select(F.col(key).alias("_k"), F.explode(F.array_distinct(F.filter(_words(F.col(column)), lambda w: is_glued(w, least)))).alias("word")).distinct()
    split = glued.join(glued_parts(glued, costs, least), "word").groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("word", F.array_join("parts", " ").alias("as")))).alias("_as"))
    joined = texts.join(split, F.col(key).eqNullSafe(F.col("_k")), "left")
    none = F.expr("map('', '')")
    text = F.array_join(F.transform(_words(F.col(column)), lambda w: F.coalesce(F.try_element_at(F.coalesce("_as", none), w), w)), " ")
    return joined.withColumn(column, F.when(F.col(column).isNotNull(), text)).select(*texts.columns)
