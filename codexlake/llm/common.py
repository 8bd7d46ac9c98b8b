"""Shared helpers of the text operators: words, fast word hashing, written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and \t \n \v \f \r. ``bytes.split()`` splits on exactly these.
WORD_GAP = r"[\x20\x09-\x0D]+"

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte (A-Z as a-z), and an odd base and its inverse for polynomial word hashes.
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_CASED = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text hashed at once.
PIECE = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length()) if n else PIECE
    if size not in _POWERS:
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, _UNBASE):
                p = np.full(size, np.uint64(base), np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
        if size > PIECE:  # rare: one word longer than a piece
            return made[0], made[1]
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(col: pa.Array, fold: bool = True, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, and where each row's words end among them.

    With `kinds` (a value for each byte) a word also ends where its bytes' kind changes.
    Works on the column's buffer as it stands, PIECE bytes at a time, so memory is bounded for texts of any length.
    """
    data, offsets = text_buffer(col)
    value = _BYTE if fold else _CASED
    hashes, starts = [], []
    at, n = 0, len(data)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets] = True
    while at < n:
        stop = min(n, at + PIECE)
        while stop < n and not (_GAP[data[stop]] or row_start[stop]):  # never inside a word
            back = data[at:stop]
            gap = np.flatnonzero(_GAP[back] | row_start[at:stop])
            stop = at + int(gap[-1]) if len(gap) and gap[-1] > 0 else min(n, stop + PIECE)
        part = data[at:stop]
        inside = ~_GAP[part]
        change = row_start[at + 1 : stop]
        if kinds is not None:
            kind = kinds[part]
            change = change | (kind[1:] != kind[:-1])
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1] | change
        begin = np.flatnonzero(fresh)
        if len(begin):
            over = ~inside
            over[1:] |= change
            # a word ends where the next gap or row begins
            edge = np.append(np.flatnonzero(over), len(part))
            end = edge[np.searchsorted(edge, begin, side="right")]
            power, inverse = _powers(len(part))
            with np.errstate(over="ignore"):
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(value[part] * power[: len(part)], out=total[1:])
                hashes.append(mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))
            starts.append(begin + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets[1:], side="left")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = getattr(spark.sparkContext, "_codexlake_dir", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="codexlake-")
            spark.sparkContext._codexlake_dir = path
    return path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "codexlake", f"{name}-{uuid.uuid4().hex}")
    batch = spark.conf.get(_BATCH)
    try:  # Python workers get their rows in small batches: long texts must not add up
        spark.conf.set(_BATCH, min(int(batch), 1000))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, batch)
    out = spark.read.schema(df.schema).parquet(path)
    out._codexlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() whose rows nothing reads any more."""
    path = getattr(df, "_codexlake_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id):
    """True where crc32 of the decimal doc_id leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
