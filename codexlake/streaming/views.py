"""Kept statistics that follow a versioned table: counts and sums by group, changed by what a version changed.

A version's change is two sets of rows: those that it took away or replaced (counted -1) and those that it brought (+1).
A view adds them up by group and merges the few groups concerned into what it holds, so a refresh costs as much as the
change, not the table. Sums are decimals, so that what is added and taken away again leaves nothing behind; averages are
quotients of them. The view's content and the version that it stands for are committed together.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.sources.manifest import Manifest
from codexlake.streaming.feeds import VersionedTable

#: The type of kept sums.
SUM = "decimal(38,6)"


class KeptCounts:
    """Rows by group: n, and the sum and number of non-null values of each measure, for the rows that a condition holds for."""

    def __init__(self, source: VersionedTable, path: str, groups: dict[str, Column], measures: dict[str, Column] | None = None, where: Column | None = None):
        self.source, self.path, self.groups, self.measures, self.where = source, path.rstrip("/"), groups, measures or {}, where
        self.spark = source.spark
        self.manifest = Manifest(self.spark, f"{self.path}/manifest")

    def _signed(self, rows: DataFrame, sign: Column) -> DataFrame:
        """One row a group with what the rows add to it."""
        if self.where is not None:
            rows = rows.filter(self.where)
        values = {m: c.cast(SUM) for m, c in self.measures.items()}
        signed = rows.select(sign.cast("long").alias("_sign"), *[c.alias(g) for g, c in self.groups.items()], *[v.alias(m) for m, v in values.items()])
        sums = [s for m in values for s in (F.sum(F.col(m) * F.col("_sign")).cast(SUM).alias(f"sum_{m}"), F.sum(F.when(F.col(m).isNotNull(), F.col("_sign"))).alias(f"n_{m}"))]
        return signed.groupBy(*self.groups).agg(F.sum("_sign").alias("n"), *sums)

    def _merged(self, parts: list[DataFrame]) -> DataFrame:
        both = reduce(DataFrame.unionByName, parts)
        names = [c for c in both.columns if c not in self.groups]
        kinds = dict(both.dtypes)
        return both.groupBy(*self.groups).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(kinds[c]).alias(c) for c in names]).filter("n <> 0")

    def refresh(self) -> tuple[int, int]:
        """Bring the view to the table's newest version; (version, versions whose changes were read: 0 for a full count)."""
        number, content = self.manifest.newest()
        target = self.source.versions()[-1]
        if content is not None and content["version"] == target:
            return target, 0
        steps = [v for v in self.source.versions() if content is not None and v > content["version"]]
        if content is None or not all(self.source.has_changes(v) for v in steps):
            found, steps = self._signed(self.source.read(target), F.lit(1)), []
        else:
            found = self._merged([self._kept(content), *[self._signed(self.source.changes(v), F.col("_change")) for v in steps]])
        folder = f"state-{uuid.uuid4().hex}"
        found.write.parquet(f"{self.path}/{folder}")
        self.manifest.commit({"folder": folder, "version": target, "schema": found._jdf.schema().toDDL()}, number)
        return target, len(steps)

    def _kept(self, content: dict) -> DataFrame:
        return self.spark.read.schema(content["schema"]).parquet(f"{self.path}/{content['folder']}")

    def read(self) -> DataFrame:
        """The groups, n, and sum and average of each measure, as of the version that was last brought in."""
        kept = self._kept(self.manifest.newest()[1])
        value = [c for m in self.measures for c in (F.when(F.col(f"n_{m}") > 0, F.col(f"sum_{m}")).alias(f"sum_{m}"), (F.col(f"sum_{m}").cast("double") / F.nullif(F.col(f"n_{m}"), F.lit(0))).alias(f"avg_{m}"))]
        return kept.select(*self.groups, "n", *value)
