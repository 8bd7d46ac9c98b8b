"""Sharding by minimax contiguous partition of equal-text groups.

Groups of equal texts are ordered by a 64-bit hash of the text and never divided. The driver looks at units, ranges of
that hash: 65,536 of its first 16 bits to begin with, however many documents there are. It searches the smallest capacity
for which a greedy pass needs no more shards than given. A pass with one byte less shows which units its shards break
off at; those that hold several groups are split by 8 further bits, and the search is repeated. When only single groups
are left there, no finer units could do with less, so the capacity is the smallest for the groups themselves. Shards
are ranges of the hash then. Slots come from counts of bounded cells: a hot unit is dealt out over as many cells as its
rows need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexlake.llm.common import written

UNIT_BITS, SPLIT_BITS = 16, 8
#: Rows of a cell, at least; larger tables get larger cells so that there are at most about 2^20 of them.
CELL = 64


def _ends(total: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Where greedily filled shards end among units with these running sums."""
    at, out = 0, []
    for _ in range(shards):
        at = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        out.append(at)
        if at == len(total) - 1:
            break
    return out


def smallest_capacity(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(capacity, ends of the shards, units that the shards of one byte less break off at) of a contiguous partition.

    Binary search over capacities between the largest unit and the total; each is checked by greedy filling, which finds
    the end of a shard by bisection of the running sums. Units of size 0 stay with the one before.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    low, high = int(max(sizes, default=0)), int(total[-1])
    while low < high:
        middle = (low + high) // 2
        if _ends(total, shards, middle)[-1] < len(sizes):
            low = middle + 1
        else:
            high = middle
    short = np.flatnonzero(sizes == low) if low == max(sizes, default=0) else np.array(_ends(total, shards, low - 1), dtype=np.int64)
    return low, np.array(_ends(total, shards, low), dtype=np.int64), short[short < len(sizes)]


def cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit: the contiguous partition into at most so many shards with the smallest largest shard."""
    return np.searchsorted(smallest_capacity(sizes, shards)[1], np.arange(len(sizes)), side="right")


def _units(base: DataFrame, bits: int, within: list[int] | None = None, of: int = 0) -> pa.Table:
    """Units of so many bits: their first hash, size, rows and whether one hash is all they hold."""
    if within is not None:
        prefixes = base.sparkSession.createDataFrame([(x,) for x in within], "prefix long")  # at most one for each cut
        base = base.join(F.broadcast(prefixes), F.shiftright("h", 64 - of) == F.col("prefix"), "left_semi")
    unit = F.shiftright("h", 64 - bits).alias("unit")
    out = base.groupBy(unit).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), (F.min("h") == F.max("h")).alias("single")).toArrow()
    return out.append_column("bits", pa.array([bits] * len(out), pa.int32()))


def _plan(base: DataFrame, shards: int) -> tuple[list[int], pa.Table]:
    """First hashes of all shards but the first, and the units of 16 bits with their rows."""
    first = units = _units(base, UNIT_BITS)
    while len(units):
        bits = units["bits"].to_numpy()
        start = units["unit"].to_numpy().astype(np.int64) << (64 - bits)
        order = np.argsort(start, kind="stable")
        units, bits, start = units.take(pa.array(order)), bits[order], start[order]
        _, ends, short = smallest_capacity(units["size"].to_numpy(), shards)
        short = short[~units["single"].to_numpy(zero_copy_only=False)[short]]
        if not len(short):
            return [int(start[e]) for e in ends if e < len(start)], first
        finer = []
        for b in np.unique(bits[short]).tolist():
            of = [int(x) for x in units["unit"].to_numpy()[short[bits[short] == b]]]
            finer.append(_units(base, min(64, b + SPLIT_BITS), of, b))
        keep = np.ones(len(units), bool)
        keep[short] = False
        units = pa.concat_tables([units.filter(pa.array(keep)), *finer])
    return [], first


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row.

    size: UTF-8 bytes of the text plus the overhead (null: the overhead alone; its CRC is 0, that of no bytes). Law
    `bytes`: the largest shard is as small as a contiguous cut of equal-text groups in the order of their hash allows.
    Equal texts share a shard, null texts too. slot
    counts each shard's rows from 0 without gaps. grown_shard is null under this law. Repeated rows each get a slot;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    )
    base = written(base.withColumn("unit", F.shiftright("h", 64 - UNIT_BITS).cast("int")), "shard-base")
    starts, units = _plan(base, shards)
    rows = units["n"].to_numpy()
    cell = max(CELL, int(rows.sum()) >> 20)
    plan = pa.table({"unit": pa.array(units["unit"].to_numpy(), pa.int32()), "cells": pa.array(-(-rows // cell), pa.int32())})
    plan = F.broadcast(spark.createDataFrame(plan.to_pandas(), "unit int, cells int"))  # at most 65,536 rows
    number = F.lit(0)
    for s in starts:  # a shard is a range of hashes
        number = number + (F.col("h") >= F.lit(s)).cast("int")
    dealt = base.join(plan, "unit").withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.col("cells")).cast("int")).drop("cells")
    counts = dealt.groupBy("shard", "unit", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("unit", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("shard", "unit", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "shard-offsets")
    within = Window.partitionBy("shard", "unit", "cell").orderBy("h", "doc_id", "size")
    placed = dealt.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["shard", "unit", "cell"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
