"""Citation graph: edges are (src, dst) rows; every operator is a join and a combined aggregate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.sources.tables import settled

#: Pairs that one task counts, about.
PAIRS_A_TASK = 2_000_000


def edges_of(payloads: DataFrame) -> DataFrame:
    """payloads(ref_id, work, referenced_works array) -> src, dst: distinct citation edges."""
    return payloads.select(F.col("ref_id").alias("src"), F.explode("referenced_works").alias("dst")).distinct()


def lookup_status(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """refs(ref_id, doi) -> ref_id, status: ok / not_found / no_doi / error of the citation lookup."""
    got = payloads.select("ref_id", F.col("error").alias("_error"), F.lit(True).alias("_there"))
    status = F.when(F.col("doi").isNull() | (F.col("doi") == ""), "no_doi").when(F.col("_error").isNotNull(), "error").when(F.col("_there"), "ok").otherwise("not_found")
    return refs.join(got, "ref_id", "left").select("ref_id", status.alias("status"))


def coupling(cites: DataFrame) -> DataFrame:
    """Pairs of citing works that share cited works: src_a < src_b, weight = shared works.

    The pairs are numbered beforehand by how often each work is cited, and dealt into tasks of so many.
    """
    shared = cites.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    parts = max(cites.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_A_TASK))
    edges = cites.select("src", "dst").repartition(parts, "dst").distinct()
    a = edges.withColumnRenamed("src", "src_a")
    b = edges.withColumnRenamed("src", "src_b")
    # hardly any pair comes twice in a task before they are dealt, so they are counted after that only
    met = a.join(b, "dst").filter("src_a < src_b").select("src_a", "src_b").repartition(parts, "src_a", "src_b")
    return met.groupBy("src_a", "src_b").agg(F.count(F.lit(1)).alias("weight"))


def cocitation(cites: DataFrame) -> DataFrame:
    """Pairs of cited works that are cited together: dst_a < dst_b, weight = citing works."""
    flipped = cites.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return coupling(flipped).select(F.col("src_a").alias("dst_a"), F.col("src_b").alias("dst_b"), "weight")


def coupled_with(cites: DataFrame, one) -> DataFrame:
    """Works that share cited works with a given one; the given side is filtered before the join."""
    edges = cites.select("src", "dst").distinct()
    mine = edges.filter(F.col("src") == F.lit(one)).select("dst")
    return edges.filter(F.col("src") != F.lit(one)).join(mine, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("weight"))


def frontier(cites: DataFrame, held: DataFrame, work: str = "work") -> DataFrame:
    """Cited works that the library lacks, with the number of citing works."""
    outside = cites.select("src", "dst").distinct().join(held.select(F.col(work).alias("dst")).distinct(), "dst", "left_anti")
    return outside.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def references(cites: DataFrame, works: DataFrame, one) -> DataFrame:
    """What one work cites, with the local id where known: dst, ref_id."""
    return cites.filter(F.col("src") == F.lit(one)).select("dst").distinct().join(works.select(F.col("work").alias("dst"), "ref_id"), "dst", "left")


def cited_by(cites: DataFrame, one) -> DataFrame:
    return cites.filter(F.col("dst") == F.lit(one)).select("src").distinct()


def follow_chains(pairs: DataFrame) -> DataFrame:
    """pairs(node, into) of merges -> node, root: the end of each chain, however long, by pointer doubling.

    Every round halves what is left of a chain, so as many as the number of pairs has binary digits reach all ends; it
    stops when no pointer moves. A chain that runs into a circle has no end: its root is null.
    """
    now = settled(pairs.select("node", F.col("into").alias("root"), F.lit(True).alias("open")))
    for _ in range(now.count().bit_length() + 1):
        if now.filter("open").isEmpty():
            break
        step = now.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        now = now.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open"))
        now = settled(now)
    return now.select("node", F.when(~F.col("open"), F.col("root")).alias("root"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """nodes(id, name, parent_id) -> id, path, depth: one join a level until no node is left. Circles have no root and no path."""
    level = settled(nodes.filter("parent_id IS NULL").select("id", F.col("name").alias("path"), F.lit(0).alias("depth")))
    out, d = level, 0
    while not level.isEmpty():
        d += 1
        level = settled(nodes.join(level.select(F.col("id").alias("parent_id"), F.col("path").alias("_up")), "parent_id").select("id", F.concat_ws("/", "_up", "name").alias("path"), F.lit(d).alias("depth")))
        out = out.unionByName(level)
    return out


def split_notes(notes: DataFrame, refs: DataFrame, passages: DataFrame) -> DataFrame:
    """notes(note_id, ref_id, chunk_id, quote) with `reason`: null if the reference exists and the quote stands verbatim
    (but for white space and case) in its passage, any of its passages or its abstract."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    text = passages.select("ref_id", "text").unionByName(refs.filter("abstract IS NOT NULL").select(F.col("id").alias("ref_id"), F.col("abstract").alias("text")))
    asked = notes.filter("quote IS NOT NULL AND quote <> ''").select("note_id", "ref_id", norm(F.col("quote")).alias("_q"))
    found = asked.join(text.select("ref_id", norm(F.col("text")).alias("_t")), "ref_id").filter(F.contains("_t", F.col("_q"))).select("note_id").distinct().withColumn("_found", F.lit(True))
    known = refs.select(F.col("id").alias("ref_id"), F.lit(True).alias("_known"))
    out = notes.join(known, "ref_id", "left").join(found, "note_id", "left")
    needs = F.col("quote").isNotNull() & (F.col("quote") != "")
    reason = F.when(F.col("_known").isNull(), "unknown reference").when(needs & F.col("_found").isNull(), "quote not found")
    return out.withColumn("reason", reason).drop("_known", "_found")
