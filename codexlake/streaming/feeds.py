"""Change feeds and rate state: versioned upserts, limits, cooldowns, expiring caches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.operators.relational import latest, upsert


class VersionedTable:
    """A Parquet table in numbered versions: a batch is merged into the newest version and written as the next.

    Readers always see a whole version; a failed write leaves none. Batches that were applied before are skipped.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", unique: str | None = None):
        self.spark, self.path, self.key, self.unique = spark, path, key, unique

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs()
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        v = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.path}/v{v}")

    def has_changes(self, version: int) -> bool:
        fs, _ = self._fs()
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_changes/v{version}/_SUCCESS"))

    def changes(self, version: int) -> DataFrame:
        """What a version changed, if it was logged: rows that went (_change -1) and rows that came (1)."""
        return self.spark.read.parquet(f"{self.path}/_changes/v{version}")

    def _log(self, old: DataFrame, new: DataFrame, version: int) -> None:
        """Write the rows in which two versions differ: those under keys that either lacks or has with other content."""
        content = lambda df: df.withColumn("_content", F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))
        a, b = (content(df).select(F.col(self.key), F.col("_content").alias(name)) for df, name in ((old, "_a"), (new, "_b")))
        keys = a.join(b, self.key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(self.key)
        rows = [df.join(keys, self.key, "left_semi").withColumn("_change", F.lit(sign)) for df, sign in ((old, -1), (new, 1))]
        rows[0].unionByName(rows[1], allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/_changes/v{version}")

    def apply(self, batch: DataFrame, version: int | None = None, mark: str | None = None, removed: DataFrame | None = None, log: bool = False) -> None:
        """Merge a batch (columns of the table and batch_seq) as the given version, or as the next; `removed` holds keys to take out.

        With `log` the rows that the version changed are kept beside it, for views that follow the table.
        A version at or below the newest is skipped. A `mark` names the batch (a stream and its epoch): it is kept beside
        the versions, and a batch whose mark is there is skipped. A batch is applied again if the driver was lost before
        its mark was made, which changes nothing: upserts by key are idempotent.
        """
        have = self.versions()
        fs, _ = self._fs()
        seen = mark and self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_batches/{mark}")
        if (seen and fs.exists(seen)) or (version is not None and have and version <= have[-1]):
            return
        if version is None:
            version = have[-1] + 1 if have else 1
        if have:
            base = self.read(have[-1])
            merged = upsert(base, batch, self.key, self.unique, keep=("created_at",) if "created_at" in base.columns else ())
        else:
            merged = latest(batch, [self.key], F.desc("batch_seq")).drop("batch_seq")
        if removed is not None:
            merged = merged.join(removed.select(self.key), self.key, "left_anti")
        if log and have:  # before the version itself: a version that is there has its changes
            merged.write.mode("overwrite").parquet(f"{self.path}/_next")
            merged = self.spark.read.parquet(f"{self.path}/_next")
            self._log(base, merged, version)
        merged.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        if seen:
            fs.create(seen).close()


def follow(changes: DataFrame, target: VersionedTable, checkpoint: str, available_now: bool = True):
    """Start a stream of changes (columns of the table and batch_seq) that upserts each micro-batch."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # a checkpoint is one stream, whatever table it feeds
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: target.apply(df, mark=f"{stream}-{epoch}"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def within_limits(calls: DataFrame, limits: dict[str, int]) -> DataFrame:
    """calls(api, ts) with `allowed`: no window of a minute, hour or day holds more calls than its limit."""
    from codexlake.operators.windows import rolling_counts

    span = {"minute": 60, "hour": 3600, "day": 86400}
    out, ok = calls, F.lit(True)
    for name, most in limits.items():
        out = rolling_counts(out, "api", "ts", span[name]).withColumnRenamed("n_window", f"_n_{name}")
        ok = ok & (F.col(f"_n_{name}") <= most)
    return out.withColumn("allowed", ok).drop(*[f"_n_{n}" for n in limits])


def cooldown_seconds(errors):
    """Pause after so many errors in a row: doubling from 30 seconds up to 300."""
    return F.least(F.lit(300.0), 15.0 * F.pow(F.lit(2.0), F.least(errors, F.lit(5))))


def strike_hours(strikes, base: float = 1.0, most: float = 12.0):
    """Pause of a host after so many challenges: doubling up to 12 hours."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), strikes - 1))


def untried(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """entries(ref_id, api, hash) that were not tried in this very form without success."""
    missed = latest(ledger, ["ref_id", "api"], F.desc("ts")).filter("outcome = 'miss'").select("ref_id", "api", "hash")
    return entries.join(missed, ["ref_id", "api", "hash"], "left_anti")


def next_backend(pools: DataFrame) -> DataFrame:
    """pools(backend, remaining, allowance) -> the one with the largest remaining share, ties by name."""
    share = F.col("remaining") / F.nullif(F.col("allowance"), F.lit(0))
    return pools.filter("remaining > 0").orderBy(F.desc(share), "backend").limit(1).select("backend")


def live_cache(entries: DataFrame, as_of, days: int = 7) -> DataFrame:
    """The newest entry of every key that is no older than the time to live."""
    fresh = entries.filter(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    return latest(fresh, ["key"], F.desc("ts"))


def dedup_stream(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "7 days") -> DataFrame:
    """First event of each key within the watermark; the state of older keys is dropped. (timestamp_ntz is cast.)"""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def cycle(steps: list[tuple[str, Callable[[], DataFrame]]]) -> list[tuple[str, str]]:
    """Run steps in order; a step that fails is reported and does not stop the others."""
    done = []
    for name, step in steps:
        try:
            step().write.format("noop").mode("overwrite").save()
            done.append((name, "ok"))
        except Exception as error:
            done.append((name, f"{type(error).__name__}: {error}"[:200]))
    return done
