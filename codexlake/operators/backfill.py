"""Bibliographies to notes, saved searches, tiered passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.functions import text as T
from codexlake.functions.model import filled, has_authors, is_strictly_complete
from codexlake.operators.relational import cascade_lookup


def match_entries(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """entries(doi, arxiv_id, title, ...) with match_id, match_by: DOI, arXiv number inside a DOI, arXiv, exact title of 12 letters and more."""
    norm = T.udf_ascii_title()
    embedded = lambda c: F.nullif(F.regexp_extract(F.lower(c), r"arxiv\.(\d{4}\.\d{4,5})", 1), F.lit(""))
    long_title = lambda c: F.when(F.length(c) >= 12, c)
    e, r = entries.withColumn("_t", norm("title")), refs.withColumn("_t", norm("title"))
    keys = [("doi", F.lower("doi"), F.lower("doi")), ("doi_arxiv", embedded(F.col("doi")), F.lower("arxiv_id")), ("arxiv", F.lower("arxiv_id"), F.lower("arxiv_id")), ("title", long_title(F.col("_t")), long_title(F.col("_t")))]
    return cascade_lookup(e, r, keys).drop("_t")


def backfill_notes(entries: DataFrame, refs: DataFrame, existing: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(new notes(project, ref_id, claim), outcome counts): matched entries with a note, but for MEMORY ones and notes there already."""
    m = match_entries(entries, refs)
    skip = F.upper(F.coalesce("level", F.lit(""))) == "MEMORY"
    result = F.when(skip, "memory").when(F.col("match_id").isNull(), "unmatched").when(~F.coalesce(filled("note"), F.lit(False)), "no note").otherwise(F.col("match_by"))
    m = m.withColumn("result", result)
    fresh = m.filter(F.col("match_id").isNotNull() & ~skip & filled("note")).select(F.lit(project).alias("project"), F.col("match_id").alias("ref_id"), F.col("note").alias("claim")).distinct()
    return fresh.join(existing.select("project", "ref_id", "claim"), ["project", "ref_id", "claim"], "left_anti"), m.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def saved_search(refs: DataFrame, filters: dict) -> DataFrame:
    """A stored search's filters as a DataFrame: years, statuses, types, file, completeness band, author, venue, tags, query."""
    f = filters
    conds = [
        F.col("year") >= f["year_from"] if f.get("year_from") is not None else None, F.col("year") <= f["year_to"] if f.get("year_to") is not None else None,
        F.coalesce("status", F.lit("unread")).isin(*f["status"]) if f.get("status") else None, F.col("ref_type").isin(*f["types"]) if f.get("types") else None,
        (filled("pdf_local") | filled("pdf_drive_id")) == F.lit(bool(f["has_pdf"])) if f.get("has_pdf") is not None else None,
        F.col("completeness").between(*f["completeness"]) if f.get("completeness") else None,
        F.contains(F.lower(F.array_join(F.transform("authors", lambda a: F.concat_ws(" ", a["given"], a["family"])), " ")), F.lit(f["author"].lower())) if f.get("author") else None,
        F.contains(F.lower(F.coalesce("journal", "container_title", F.lit(""))), F.lit(f["venue"].lower())) if f.get("venue") else None,
        F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(f["query"].lower())) if f.get("query") else None,
    ]
    for t in f.get("tags", ()):
        conds.append(F.array_contains("tags", t))
    for c in conds:
        if c is not None:
            refs = refs.filter(c)
    return refs


def tier_passes(queue: DataFrame, refs: DataFrame, handlers: dict[int, Callable[[DataFrame], DataFrame]], n: int = 250) -> DataFrame:
    """One set-based pass over the tiers in order, the first once more at the end: outcomes of every handler together.

    A handler takes its tier's queue rows and returns (ref_id, completeness, error).
    """
    from codexlake.sources.tables import settled
    from codexlake.streaming.queue import dequeue

    out = None
    for tier in [*sorted(handlers), min(handlers)]:
        rows = dequeue(queue, refs, tier, n, skip=out)  # those handled go before the n most urgent are taken
        done = settled(handlers[tier](rows).withColumn("tier", F.lit(tier)))
        out = done if out is None else out.unionByName(done)
    return out


def metadata_candidates(refs: DataFrame, n: int) -> DataFrame:
    """Records with a DOI that lack something or an open address: those short of a publisher only first, then by completeness and year."""
    whole = F.coalesce(is_strictly_complete(), F.lit(False))
    no_address = ~F.coalesce(filled("oa_url"), F.lit(False))
    only_publisher = F.coalesce(filled("title") & has_authors() & F.col("year").isNotNull() & (F.col("year") != 0), F.lit(False)) & ~F.coalesce(filled("publisher"), F.lit(False))
    rank = F.when(only_publisher, 1).when(~whole, 2).otherwise(3)
    return refs.filter(filled("doi") & (~whole | no_address)).orderBy(rank, F.desc_nulls_last("completeness"), F.desc_nulls_last("year"), "id").limit(n)


def file_candidates(refs: DataFrame, ledger: DataFrame, n: int) -> DataFrame:
    """Records without a file that could get one, not tried in vain before: arXiv, open address, DOI; newest first."""
    from codexlake.functions.scalar import entry_hash

    missing = ~F.coalesce(filled("pdf_local"), F.lit(False)) & ~F.coalesce(filled("pdf_drive_id"), F.lit(False))
    rank = F.when(filled("arxiv_id"), 1).when(filled("oa_url"), 2).when(filled("doi"), 3)
    open_ones = refs.filter(missing & rank.isNotNull()).withColumn("entry_hash", entry_hash())
    missed = ledger.filter(F.col("api").isin("pdf", "pdf_oa") & F.col("result").isin("miss", "error")).select(F.col("ref_id").alias("id"), "entry_hash")
    return open_ones.join(missed, ["id", "entry_hash"], "left_anti").orderBy(rank, F.desc_nulls_last("year"), "id").limit(n).drop("entry_hash")
