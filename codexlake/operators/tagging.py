"""Tags: declarative rules compiled to predicates, heuristics, a topic table, suggestions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions.model import filled
from codexlake.functions.topics import TOPICS


@dataclass(frozen=True)
class TagRule:
    """All criteria that are set must hold."""

    tags: Sequence[str]
    keywords: Sequence[str] = field(default_factory=tuple)
    journal_pattern: str | None = None
    ref_type: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    open_access_only: bool = False

    def predicate(self) -> Column:
        cond = F.lit(True)
        if self.keywords:
            hay, any_of = haystack(), F.lit(False)
            for k in self.keywords:
                any_of = any_of | F.contains(hay, F.lit(k.lower()))
            cond = cond & any_of
        if self.journal_pattern:
            cond = cond & F.coalesce("journal", "container_title", F.lit("")).rlike("(?i)" + self.journal_pattern)
        if self.ref_type:
            cond = cond & (F.col("ref_type") == self.ref_type)
        if self.year_from is not None:
            cond = cond & (F.col("year") >= self.year_from)
        if self.year_to is not None:
            cond = cond & (F.col("year") <= self.year_to)
        if self.open_access_only:
            cond = cond & F.col("open_access")
        return F.coalesce(cond, F.lit(False))


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "title", "abstract", F.array_join("keywords", " ")))


def auto_tags(refs: DataFrame, rules: Sequence[TagRule] = (), by_type: bool = True, by_year: bool = True, open_access: bool = True) -> DataFrame:
    """refs with `tags`: heuristics, then rules in order, lower case, no doubles."""
    when = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v if isinstance(v, Column) else F.lit(v))
    parts = []
    if by_type:
        parts.append(when(filled("ref_type") & ~F.col("ref_type").isin("unknown", "other"), F.col("ref_type")))
    if open_access:
        parts.append(when(F.col("open_access"), "open-access"))
    if by_year:
        parts.append(F.col("year").cast("string"))
    parts += [when(F.col("completeness") >= 0.9, "complete"), when(F.col("completeness") < 0.4, "incomplete"), when(filled("arxiv_id") & (F.col("ref_type") != "journal-article"), "preprint")]
    for r in rules:
        parts += [when(r.predicate(), F.lit(t.strip().lower())) for t in r.tags if t.strip()]
    return refs.withColumn("tags", F.array_distinct(F.array_compact(F.array(*parts))))


@lru_cache(8)
def _triggers(taxonomy: tuple[tuple[str, tuple[str, ...]], ...]):
    """(automaton of all triggers, each with the numbers of its topics; topics that an empty trigger gives to every text)."""
    topics: dict[str, set[int]] = {}
    for i, (_, triggers) in enumerate(taxonomy):
        for t in triggers:
            topics.setdefault(t, set()).add(i)
    everywhere = topics.pop("", set())
    if not topics:
        return None, everywhere
    automaton = ahocorasick.Automaton()
    for t, of in topics.items():
        automaton.add_word(t, of)
    automaton.make_automaton()
    return automaton, everywhere


def topic_tags(refs: DataFrame, taxonomy: Mapping[str, Sequence[str]] = TOPICS, text: Column | None = None) -> DataFrame:
    """refs with `topics`: every topic one of whose triggers occurs in the text, in the table's order; none for a null text.

    The text (title, abstract and keywords by default) must be in the triggers' case. All triggers are looked for in one
    pass over it, by an automaton that each worker builds once from the table, which travels with the plan.
    """
    table = tuple((topic, tuple(triggers)) for topic, triggers in taxonomy.items())

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        automaton, everywhere = _triggers(table)

        def topics(t: str | None) -> list[str]:
            if t is None:
                return []
            found = set(everywhere)
            for _, of in automaton.iter(t) if automaton else ():
                found |= of
            return [table[i][0] for i in sorted(found)]

        return texts.map(topics)

    return refs.withColumn("topics", run(haystack() if text is None else text))


def suggest_tags(refs: DataFrame, tags: DataFrame, text: Column, id_col: str = "id", most: int = 10) -> DataFrame:
    """id, tag: up to 10 existing tags of one word that occur as words of the text, by name; equi-join on words."""
    words = refs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.split(F.lower(text), r"(?U)[^\w-]+"))).alias("tag"))
    hits = words.join(tags.select(F.lower("name").alias("tag")).distinct(), "tag")
    from codexlake.operators.windows import capped_per_group

    return capped_per_group(hits, "id", [F.col("tag")], most)
