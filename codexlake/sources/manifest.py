"""A numbered list of small JSON files: the newest whole one says what a stored thing consists of.

Data is written first, under names of its own; then one file is moved into place, and all of it counts at once. What a
lost writer has left behind is named by no file, and a file that was not written to its end is passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the state was read."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _where(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._where().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._where()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._where())]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict | None:
        """The content of one file; None if it is torn or missing."""
        fs, where = self._fs(), self._where(f"{number:08d}.json")
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) and found.pop("whole", False) else None

    def newest(self) -> tuple[int, dict | None]:
        """(number, content) of the newest whole file; (0, None) if there is none."""
        for number in reversed(self.numbers()):
            found = self.read(number)
            if found is not None:
                return number, found
        return 0, None

    def commit(self, content: dict, after: int) -> int:
        """Write the file that follows number `after`, unless another writer has done so; torn ones in between are passed over."""
        fs = self._fs()
        if self.newest()[0] != after:
            raise Conflict(f"{self.path}: number {after} is not the newest any more")
        number = max([after, *self.numbers()]) + 1
        draft, final = self._where(f"_{uuid.uuid4().hex}"), self._where(f"{number:08d}.json")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(content | {"whole": True}).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise Conflict(f"{self.path}: number {number} was taken")
        return number
