"""Files as tables: listings, texts out of binary files by an injected extractor, what a file's name says."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, mtime of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], ocr: Callable[[bytes], list[str]] | None = None, pattern: str = "*") -> DataFrame:
    """path, page, text, status (ok / empty / error: ...) of files; `ocr` is asked where the extractor finds no text."""

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    texts = extract(bytes(content))
                    if ocr and not any(t.strip() for t in texts):
                        texts = ocr(bytes(content))
                except Exception as error:  # one damaged file must not end the job; its row says so
                    rows.append((p, 0, None, f"error: {type(error).__name__}"))
                    continue
                rows += [(p, i + 1, t, "ok" if t.strip() else "empty") for i, t in enumerate(texts)] or [(p, 0, None, "empty")]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "status"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "content").mapInPandas(run, "path string, page int, text string, status string")


def filename_meta(name: str) -> dict:
    """doi, isbn, arxiv_id, year, author and title of a file name; escapes of names undone."""
    from urllib.parse import unquote

    stem = re.sub(r"(?i)\.(?:pdf|epub|djvu|docx?|txt)$", "", unquote(name.rsplit("/", 1)[-1]))
    out = dict.fromkeys(("doi", "isbn", "arxiv_id", "year", "author", "title"))
    m = re.search(r"(10\.\d{4,9})[_/@]([^\s]+)", stem)
    if m:
        out["doi"] = f"{m[1]}/{m[2]}".lower()
        stem = stem.replace(m[0], " ")
    m = re.search(r"(?<!\d)(97[89]\d{10})(?!\d)", stem)
    if m:
        out["isbn"] = m[1]
        stem = stem.replace(m[0], " ")
    m = re.search(r"(?<!\d)(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)", stem)
    if m:
        out["arxiv_id"] = m[1]
        stem = stem.replace(m[0], " ")
    m = re.search(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)", stem)
    if m:
        out["year"] = int(m[1])
        before, after = stem[: m.start()], stem[m.end() :]
        who = re.match(r"^[\s_([-]*([^\W\d_]{2,})", before)
        if who and len(re.findall(r"[^\W\d_]+", before)) <= 4:
            out["author"] = who[1]
            stem = after
        else:
            stem = f"{before} {after}"
    title = " ".join(re.sub(r"[_\-.()\[\]]+", " ", stem).split())
    out["title"] = title or None
    return out


def udf_filename_meta():
    @F.pandas_udf("doi string, isbn string, arxiv_id string, year int, author string, title string")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([filename_meta(s or "") for s in x], columns=["doi", "isbn", "arxiv_id", "year", "author", "title"]).astype({"year": "Int32"})

    return run
