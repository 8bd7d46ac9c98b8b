"""Several tables that change together: one commit names a version of each, restore points are commits with a label.

A table's version is a folder that is written once. A commit is one small file (see manifest) with the folder of every
table, so readers see the tables of one commit or of another, never a mixture; folders of a commit that was not finished
are named by nobody.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codexlake.sources.manifest import Manifest


class Library:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def tables(self, number: int | None = None) -> dict[str, dict]:
        """name -> folder and schema of each table, in the newest commit or a given one."""
        content = self.manifest.newest()[1] if number is None else self.manifest.read(number)
        if number is not None and content is None:
            raise ValueError(f"there is no commit {number}")
        return (content or {"tables": {}})["tables"]

    def read(self, name: str, number: int | None = None) -> DataFrame:
        one = self.tables(number)[name]
        return self.spark.read.schema(one["schema"]).parquet(f"{self.path}/{one['folder']}")

    def commit(self, changes: dict[str, DataFrame], label: str | None = None) -> int:
        """Write new versions of some tables and make them count at once; the others stay. The commit's number."""
        number, content = self.manifest.newest()
        tables = dict((content or {"tables": {}})["tables"])
        for name, df in changes.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            tables[name] = {"folder": folder, "schema": df._jdf.schema().toDDL()}
        return self.manifest.commit({"tables": tables, "label": label}, number)

    def mark(self, label: str) -> int:
        """A restore point: the tables as they are, under a label. Nothing is copied."""
        return self.commit({}, label)

    def points(self) -> list[tuple[int, str]]:
        """(number, label) of all restore points, in order."""
        found = [(n, self.manifest.read(n)) for n in self.manifest.numbers()]
        return [(n, c["label"]) for n, c in found if c and c["label"]]

    def restore(self, label: str) -> int:
        """All tables as they were at the newest restore point of that label; tables made since are no longer there."""
        found = [n for n, name in self.points() if name == label]
        if not found:
            raise ValueError(f"there is no restore point {label}")
        return self.manifest.commit({"tables": self.tables(found[-1]), "label": None}, self.manifest.newest()[0])

    def unnamed(self) -> list[str]:
        """Folders that no commit names: what unfinished commits have left. Deleting them is safe when nobody is writing."""
        fs, where = self.manifest._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        named = {t["folder"] for n in self.manifest.numbers() for t in (self.manifest.read(n) or {"tables": {}})["tables"].values()}
        return sorted({s.getPath().getName() for s in fs.listStatus(where)} - named - {"manifest"}) if fs.exists(where) else []
