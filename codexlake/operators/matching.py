"""Pairwise decisions: is this hit the entry, does this record fit, which title is better."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.sources.tables import spread

from codexlake.functions import text as T
from codexlake.functions.model import filled


def words_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct words that b has."""
    wa = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(a, F.lit(""))), r"(?U)\W+"), lambda w: w != ""))
    wb = F.split(F.lower(F.coalesce(b, F.lit(""))), r"(?U)\W+")
    return F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.lit(1))


def contained(title: Column, page: Column) -> Column:
    """At least max(2, 60 %) of a title's words occur on a page."""
    wa = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\W+"), lambda w: F.length(w) > 2))
    hit = F.size(F.array_intersect(wa, F.split(F.lower(F.coalesce(page, F.lit(""))), r"(?U)\W+")))
    return hit >= F.greatest(F.lit(2), F.ceil(F.size(wa) * 0.6))


def wording_hit(abstract: Column, text: Column, run: int = 8) -> Column:
    """A run of so many consecutive words is shared, or 60 % of the abstract's first 40 words occur."""
    norm = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    grams = lambda ws: F.when(F.size(ws) >= run, F.transform(F.sequence(F.lit(1), F.size(ws) - run + 1), lambda i: F.array_join(F.slice(ws, i, run), " "))).otherwise(F.array().cast("array<string>"))
    opening = F.array_distinct(F.slice(norm(abstract), 1, 40))
    return F.arrays_overlap(grams(norm(abstract)), grams(norm(text))) | ((F.size(opening) >= 10) & (F.size(F.array_intersect(opening, norm(text))) >= 0.6 * F.size(opening)))


def names_overlap(a: Column, b: Column) -> Column:
    """Any name part of three letters and more in common."""
    parts = lambda people: F.filter(F.flatten(F.transform(people, lambda p: F.split(F.lower(F.concat_ws(" ", p["family"], p["given"])), r"(?U)\W+"))), lambda w: F.length(w) >= 3)
    return F.arrays_overlap(parts(a), parts(b))


def record_fits(title_a: Column, title_b: Column, year_a: Column, year_b: Column, authors_a: Column, authors_b: Column) -> Column:
    """Titles cover each other by 0.6, years differ by two at most, and authors overlap where both are known."""
    years = F.coalesce(F.abs(year_a - year_b) <= 2, F.lit(True))
    people = F.when((F.size(authors_a) > 0) & (F.size(authors_b) > 0), names_overlap(authors_a, authors_b)).otherwise(True)
    return (words_overlap(title_a, title_b) >= 0.6) & years & F.coalesce(people, F.lit(True))


def better_title(stored: Column, found: Column) -> Column:
    """The found title unless it has fewer words and is no extension of the stored one."""
    ws = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))
    extends = F.slice(ws(found), F.lit(1), F.greatest(F.size(ws(stored)), F.lit(1))) == ws(stored)
    return F.when(~filled(stored), found).when(~filled(found) | ((F.size(ws(found)) < F.size(ws(stored))) & ~extends), stored).otherwise(found)


def hit_score(title: str, surnames: list[str], series: str | None, volume: str | None, year: int | None, hit_title: str, snippet: str) -> float:
    """How sure a web hit is the entry: title ratio, raised by author and year, lowered by a missing author or another volume."""
    a, b = T.fold(title), T.fold(hit_title)
    if not a or not b:
        return 0.0
    ratio = T.sequence_ratio(a, b)
    if len(a.split()) >= 3 and (b.startswith(a) or (a.startswith(b) and len(b.split()) >= 3 and "..." in hit_title)):
        ratio = max(ratio, 0.95)
    around = T.fold(f"{hit_title} {snippet}")
    if surnames:
        ratio += 0.05 if any(T.fold(s) in around for s in surnames) else -0.1
    if year and str(year) in around:
        ratio += 0.02
    if volume and series and T.fold(series) in around:
        numbers = set(re.findall(r"\d+", hit_title))
        if numbers and str(volume) not in numbers:
            ratio -= 0.3
    return max(0.0, min(1.0, ratio))


def udf_hit_score():
    @F.pandas_udf("double")
    def run(title: pd.Series, surnames: pd.Series, series: pd.Series, volume: pd.Series, year: pd.Series, hit: pd.Series, snippet: pd.Series) -> pd.Series:
        cols = zip(title, surnames, series, volume, year, hit, snippet)
        return pd.Series([hit_score(t or "", list(s) if s is not None else [], se, v, None if y is None or y != y else int(y), h or "", sn or "") for t, s, se, v, y, h, sn in cols])

    return run


def best_hits(refs: DataFrame, hits: DataFrame, least: float = 0.85) -> DataFrame:
    """refs(id, title, surnames, series, volume, year), hits(ref_id, backend, title, url, snippet) -> ref_id, url, backend, score.

    The best web hit of each record that is sure enough; equal scores go to the better address, then by name.
    """
    from codexlake.functions.scalar import url_rank

    h = hits.select(F.col("ref_id").alias("id"), "backend", "url", F.col("title").alias("_hit"), "snippet")
    x = refs.select("id", "title", "surnames", "series", "volume", "year").join(h, "id")
    x = x.withColumn("score", F.round(udf_hit_score()("title", "surnames", "series", "volume", "year", "_hit", "snippet"), 6)).filter(F.col("score") >= least)
    best = F.max_by(F.struct("url", "backend", "score"), F.struct("score", url_rank(F.col("url")), "url", "backend"))
    return x.groupBy(F.col("id").alias("ref_id")).agg(best.alias("b")).select("ref_id", "b.*")


def local_candidates(seeds: DataFrame, refs: DataFrame, most: int = 6) -> DataFrame:
    """seeds(seed_id, doi, pmid, arxiv_id, isbn, title) -> seed_id, id, score: the best local records by identifier or title.

    Equal scores go by id, so of all records with one value of a key only the first `most` can be among a seed's best:
    the seeds meet those, however many records share a title.
    """
    from codexlake.operators.windows import capped_per_group

    norm = T.udf_ascii_title()
    keys = [(filled(c), F.lower(c), score) for c, score in (("doi", 1.0), ("pmid", 0.97), ("arxiv_id", 0.95), ("isbn", 0.85))] + [(F.lit(True), norm("title"), 0.8)]
    parts = None
    for there, key, score in keys:
        side = lambda df, name: df.filter(there).select(name, key.alias("_k")).filter("_k <> ''").distinct()  # noqa: B023, E731
        first = capped_per_group(side(refs, "id"), "_k", [F.col("id")], most)
        one = side(seeds, "seed_id").join(first, "_k").select("seed_id", "id", F.lit(score).alias("score"))
        parts = one if parts is None else parts.unionByName(one)
    best = parts.groupBy("seed_id", "id").agg(F.max("score").alias("score"))
    return capped_per_group(best, "seed_id", [F.desc("score"), F.col("id")], most)


def fill_empty(stored: DataFrame, found: DataFrame, columns: list[str], key: str = "id", ratio: float = 0.9) -> DataFrame:
    """Found values where the stored ones are empty; a title is also replaced if the two differ (sequence ratio under 0.9)."""
    x = stored.join(found.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    for c in columns:
        empty = ~F.coalesce(filled(F.col(c).cast("string")), F.lit(False))
        if c == "title":
            empty = empty | (filled("_title") & (T.udf_sequence_ratio()(F.lower("title"), F.lower("_title")) < ratio))
        x = x.withColumn(c, F.when(empty, F.col(f"_{c}")).otherwise(F.col(c)))
    return x.select(stored.columns)


def ingest_outcome(relevant: Column, known_id: Column, has_file: Column, resolved: Column) -> Column:
    """skipped / exists / attached / created / created_unresolved for one incoming file."""
    return F.when(~relevant, "skipped").when(known_id.isNotNull() & has_file, "exists").when(known_id.isNotNull(), "attached").when(resolved, "created").otherwise("created_unresolved")


def similar_sets(rows: DataFrame, percent: int) -> DataFrame:
    """rows(id, words) -> a, b, jaccard of all pairs of sets whose Jaccard overlap reaches percent.

    Sets that similar share one of each set's rarest words, as many as it may lack; only those are joined, so a word that
    all sets hold makes no pairs.
    """
    each = rows.select("id", F.explode("words").alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word")
    rarest = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("words"))
    few = F.size("words") - F.ceil(F.size("words") * percent / 100).cast("int") + 1
    keys = rarest.select("id", F.explode(F.slice("words", F.lit(1), few)).alias("word"))
    pairs = keys.toDF("a", "word").join(keys.toDF("b", "word"), "word").filter("a < b").select("a", "b").distinct()
    full = pairs.join(rows.toDF("a", "wa"), "a").join(rows.toDF("b", "wb"), "b")
    both, either = F.size(F.array_intersect("wa", "wb")), F.size(F.array_union("wa", "wb"))
    return full.filter(100 * both >= percent * either).select("a", "b", (both / either).alias("jaccard"))


def titles_on_pages(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """titles(title_id, title), pages(page_id, page) -> title_id, page_id of all pages that hold a title's words (contained()).

    A page that lacks at most 40 % of a title's words has one of its rarest, so only those are joined; they are ranked by
    how many titles and pages hold them.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+"), lambda w: F.length(w) > 2))
    t = titles.select("title_id", F.explode(words(F.col("title"))).alias("word"))
    p = spread(pages).select("page_id", F.explode(words(F.col("page"))).alias("word")).join(t.select("word").distinct(), "word", "left_semi")
    often = p.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    each = t.join(often, "word", "left").groupBy("title_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))), lambda x: x["word"]).alias("ws"))
    few = F.size("ws") - F.greatest(F.lit(2), F.ceil(F.size("ws") * 0.6).cast("int")) + 1
    keys = each.filter(few > 0).select("title_id", F.explode(F.slice("ws", F.lit(1), few)).alias("word"))
    pairs = p.join(keys, "word").select("title_id", "page_id").distinct()
    # of a page only the words that some title has count, so the texts are not needed again
    held = p.groupBy("page_id").agg(F.collect_set("word").alias("held"))
    full = pairs.join(each, "title_id").join(held, "page_id")
    return full.filter(F.size(F.array_intersect("ws", "held")) >= F.greatest(F.lit(2), F.ceil(F.size("ws") * 0.6))).select("title_id", "page_id")
