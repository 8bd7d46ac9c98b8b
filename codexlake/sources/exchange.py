"""Pages of records exchanged with a service: pushes as a sink, pulls since a version as a source.

A push writes pages of rows first and then one commit file that names them, so pages of a task that was lost and started
again, or of an epoch that a restarted stream repeats, are never seen. A pull plans one partition for each page whose
versions a filter on the version column allows, so a pull since a version reads no older pages.

The service here is a folder (any that pyarrow's file systems reach from all machines). Another one is a subclass of
Service with the same five calls.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

PAGE_ROWS = 1000


class Service:
    """Pages and commits in a folder."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def put_page(self, lines: list[str]) -> str:
        name = f"page-{uuid.uuid4().hex}.jsonl"
        self.files.create_dir(self.root, recursive=True)
        with self.files.open_output_stream(f"{self.root}/{name}") as out:
            out.write("".join(line + "\n" for line in lines).encode())
        return name

    def get_page(self, name: str) -> Iterator[dict]:
        with self.files.open_input_stream(f"{self.root}/{name}") as page:
            for line in page.read().decode().splitlines():
                yield json.loads(line)

    def drop_page(self, name: str) -> None:
        if self.files.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound:
            self.files.delete_file(f"{self.root}/{name}")

    def put_commit(self, key: str, pages: list[dict]) -> bool:
        """Make pages count; False, and nothing happens, if that key has been committed before."""
        final = f"{self.root}/commit-{key}.json"
        if self.files.get_file_info(final).type != fs.FileType.NotFound:
            return False
        self.files.create_dir(self.root, recursive=True)
        draft = f"{self.root}/_{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as out:
            out.write(json.dumps(pages).encode())
        self.files.move(draft, final)
        return True

    def get_commits(self) -> list[dict]:
        """name, first and last version, and rows of all pages that count."""
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        names = sorted(f.path for f in found if f.base_name.startswith("commit-") and f.base_name.endswith(".json"))
        pages = []
        for name in names:
            with self.files.open_input_stream(name) as commit:
                pages += json.loads(commit.read())
        return pages


@dataclass
class Pages(WriterCommitMessage):
    pages: list[dict]


class _Push:
    """What a task does for either kind of writer."""

    def __init__(self, options: dict):
        self.path, self.version, self.rows = options["path"], options.get("version", "version"), int(options.get("page_rows", PAGE_ROWS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pages:
        service, pages, held = Service(self.path), [], []

        def close() -> None:
            versions = [r[self.version] for r in held if r[self.version] is not None]
            name = service.put_page([json.dumps(r, default=str) for r in held])
            pages.append({"name": name, "rows": len(held), "first": min(versions, default=None), "last": max(versions, default=None)})
            held.clear()

        for batch in iterator:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) >= self.rows:
                    close()
        if held:
            close()
        return Pages(pages)

    def _commit(self, messages: list[Pages | None], key: str) -> None:
        pages = [p for m in messages if m is not None for p in m.pages]
        if not Service(self.path).put_commit(key, pages):
            self._abort(messages)

    def _abort(self, messages: list[Pages | None]) -> None:
        for m in messages:
            for p in m.pages if m is not None else ():
                Service(self.path).drop_page(p["name"])


class PushWriter(_Push, DataSourceArrowWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.key = options.get("push", uuid.uuid4().hex)  # named pushes are made once, however often they are tried

    def commit(self, messages) -> None:
        self._commit(messages, self.key)

    def abort(self, messages) -> None:
        self._abort(messages)


class PushStream(_Push, DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.stream = options.get("push", "stream")

    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, f"{self.stream}-{batchId:012d}")

    def abort(self, messages, batchId: int) -> None:
        self._abort(messages)


class Page(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class PullReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.version = options["path"], options.get("version", "version")
        self.columns = schema.names
        self.at_least = self.at_most = None

    def pushFilters(self, filters):
        """Bounds on the version choose the pages; Spark filters their rows itself."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.version,):
                low = min(f.value) if isinstance(f, In) and f.value else f.value if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None
                high = max(f.value) if isinstance(f, In) and f.value else f.value if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
                if low is not None:
                    low += isinstance(f, GreaterThan)
                    self.at_least = low if self.at_least is None else max(low, self.at_least)
                if high is not None:
                    high -= isinstance(f, LessThan)
                    self.at_most = high if self.at_most is None else min(high, self.at_most)
            yield f

    def partitions(self) -> list[Page]:
        bounded = self.at_least is not None or self.at_most is not None
        chosen = []
        for p in Service(self.path).get_commits():
            if p["first"] is None:
                fits = not bounded  # rows without a version meet no bound
            else:
                fits = (self.at_least is None or p["last"] >= self.at_least) and (self.at_most is None or p["first"] <= self.at_most)
            if fits:
                chosen.append(Page(p["name"]))
        return chosen or [Page("")]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in Service(self.path).get_page(partition.value) if partition.value else ():
            yield tuple(row.get(c) for c in self.columns)


class PageExchange(DataSource):
    """format("page_exchange") with the options path, version (a column of whole numbers; "version"), page_rows and push (a name that makes a push happen once). Reading needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "page_exchange"

    def reader(self, schema):
        return PullReader(self.options, schema)

    def writer(self, schema, overwrite: bool):
        return PushWriter(self.options)

    def streamWriter(self, schema, overwrite: bool):
        return PushStream(self.options)


def register(spark) -> None:
    """Make the format known and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageExchange)
