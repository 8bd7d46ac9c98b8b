"""Window operators: survivors, rank fusion, caps per group, round robin, eviction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivors(df: DataFrame, keys: Sequence[Column | str], quality: Column, created: str = "created_at", id_col: str = "id", sides: Sequence[str] = ()) -> DataFrame:
    """(keep_id, drop_id) pairs: in each key group the row of best quality stays, ties to the oldest, then smallest id.

    `sides` are columns to have of both rows besides, as k_ and d_. The best row comes from a combined aggregate and is
    joined back, so a hot key never sorts in one task: a task holds its share of the best rows. The join says its kind, for
    by the size of a file, which says little of the rows computed from it, the planner sends whole tables to every task.
    """
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    held = [f"d_{c}" for c in sides]
    work = df.select(F.col(id_col).alias("id"), F.col(created).alias("created"), quality.alias("quality"), *[k.alias(f"k{i}") for i, k in enumerate(named)], *[F.col(c).alias(h) for c, h in zip(sides, held)])
    names = [f"k{i}" for i in range(len(named))]
    for n in names:
        work = work.filter(F.col(n).isNotNull())
    best = work.groupBy(*names).agg(F.min_by(F.struct("id", *held), F.struct(-F.col("quality"), F.col("created"), F.col("id"))).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = best.select(*names, F.col("best.id").alias("keep_id"), *[F.col(f"best.d_{c}").alias(f"k_{c}") for c in sides])
    return work.join(best.hint("shuffle_hash"), names).filter("id <> keep_id").select("keep_id", F.col("id").alias("drop_id"), *[f"k_{c}" for c in sides], *held)


def rank_fusion(rankings: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of tables (key, rank): the sum of 1 / (k + rank)."""
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def capped_per_group(df: DataFrame, group: str, order: Sequence[Column], cap: int) -> DataFrame:
    """At most cap rows of each group, best first; limits apply before the shuffle too (group limit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= cap).drop("_rn")


def round_robin(df: DataFrame, group: str, order: Sequence[Column], first_seen: Column) -> DataFrame:
    """df with `turn` and `seen`: ordered by (turn, seen) rows alternate over the groups in order of their first row."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    seen = df.groupBy(group).agg(F.min(first_seen).alias("seen"))
    return df.withColumn("turn", turn).join(seen, group)


def evict_oldest(files: DataFrame, limit: int) -> DataFrame:
    """Files to delete, oldest first, until the rest fits the limit.

    Running sums are taken per day of mtime, then the offsets of the days (one row a day) are added.
    """
    day = F.floor(F.col("mtime") / 86400)
    x = files.withColumn("_day", day)
    days = x.groupBy("_day").agg(F.sum("size").alias("_s"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(F.lit(0))).alias("_total"))
    within = Window.partitionBy("_day").orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(F.broadcast(days), "_day")
    return x.filter(F.col("_total") - F.col("_before") - F.col("_in") > limit).drop("_day", "_in", "_before", "_total")


def rolling_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Each event with the number of its key's events in the window before it (itself included)."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_window", F.count(F.lit(1)).over(w))
