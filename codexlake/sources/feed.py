"""A streaming source over a versioned change log: the offset is the library version last seen.

The log is a folder of JSON-lines files named by version. With a client of a live service in place of `_changes`, the
same reader follows that service.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class VersionLog(DataSource):
    """spark.dataSource.register(VersionLog); spark.readStream.format("version_log").option("path", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "version_log"

    def schema(self) -> str:
        return "id string, title string, version long, batch_seq long"

    def simpleStreamReader(self, schema):
        return _Reader(self.options["path"])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def _changes(self, after: int, upto: int | None = None) -> list[tuple]:
        out = []
        for p in sorted(Path(self.path).glob("*.jsonl"), key=lambda p: int(p.stem)):
            v = int(p.stem)
            if v > after and (upto is None or v <= upto):
                rows = [json.loads(x) for x in p.read_text().splitlines() if x.strip()]
                out += [(r["id"], r.get("title"), v, (v << 32) + i) for i, r in enumerate(rows)]
        return out

    def read(self, start: dict):
        rows = self._changes(start["version"])
        return iter(rows), {"version": max([start["version"], *(r[2] for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._changes(start["version"], end["version"]))

    def commit(self, end: dict) -> None:
        pass
