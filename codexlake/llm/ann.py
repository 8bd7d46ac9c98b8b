"""Approximate nearest neighbours by a permutation index.

A vector is represented by its pivots in order of nearness. The pivots are a bounded sample; every vector is indexed: it
is posted in the inverted files of its POST nearest pivots. A query opens the files of its own nearest pivots only,
ranks the rows found there by the footrule distance of the permutations and reranks the nearest by exact cosine. A row
that several opened files hold is ranked in the first of them alone. Files and the queries that open them are cut into
blocks, so no task holds more than a bounded number of either, and only each block's best few go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StructField, StructType

from codexlake.llm.common import written

#: Pivots (the bounded sample; a quarter of the rows in small tables), and the length of a permutation that is compared.
PIVOTS, PREFIX = 256, 64
#: Files that a vector is posted in, the share of files that a query opens, and the fewest.
POST, OPENED, LEAST_OPENED = 3, 1 / 3, 16
#: Share of an opened block's rows that is reranked, and the fewest rows.
SHARE, FEWEST = 0.3, 48
#: Rows and queries of a block, at most about.
FILE_ROWS, FILE_QUERIES = 8192, 2048


def _matrix(col) -> np.ndarray:
    """Vectors of equal length as float64."""
    values = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(values), -1)


def permutations(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first (ties to the earlier pivot)."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _orders(pivots: np.ndarray, length: int):
    """(vec_id, v) -> the same with `perm`, the row's nearest pivots."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                order = permutations(_unit(_matrix(part.column(1))), pivots, length).astype(np.int16)
                ends = np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(order.reshape(-1)))], names=["vec_id", "v", "perm"])

    return run


def _search(pivots: int, k: int, prefix: int, post: int, opened: int, share: float, fewest: int):
    """One block of a file: its queries against its rows."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy(zero_copy_only=False)
        x, ids, this = _matrix(table["v"]), table["vec_id"].to_numpy(), table["file"][0].as_py()
        perm = table["perm"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.int64)
        rows, asked = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        out = [[], [], []]
        if len(rows) and len(asked):
            own, own_id = x[rows], ids[rows]
            norm = np.sqrt((own * own).sum(axis=1))
            repeats = len(np.unique(own_id)) < len(own_id)
            posted = perm[rows, :post]
            earlier = np.cumsum(posted == this, axis=1) == 0  # the files before this one that a row is posted in
            places = np.zeros((pivots, len(rows)), np.uint8)  # places from the end, 0 beyond the prefix
            places[perm[rows, :prefix], np.arange(len(rows))[:, None]] = np.arange(prefix, prefix - perm[:, :prefix].shape[1], -1, dtype=np.uint8)
            weights = np.arange(prefix, 0, -1, dtype=np.uint8)[:, None]
            for i in asked.tolist():
                opens = np.zeros(pivots, bool)
                opens[perm[i, :opened]] = True
                here = np.flatnonzero(~(opens[posted] & earlier).any(axis=1) & (own_id != ids[i]))
                take = max(fewest, int(np.ceil(share * len(here))))
                if take < len(here):
                    # footrule = constant - 2 * sum over shared pivots of the smaller place from the end
                    shared = np.minimum(places[perm[i, :prefix]], weights[: perm.shape[1]]).sum(axis=0, dtype=np.uint16)[here]
                    here = here[shared >= np.partition(shared, len(here) - take)[len(here) - take]]
                score = (own[here] * x[i]).sum(axis=1) / (norm[here] * np.sqrt((x[i] * x[i]).sum()))
                best = np.lexsort((own_id[here], -score))
                if repeats:  # the best of each id
                    best = best[np.sort(np.unique(own_id[here[best]], return_index=True)[1])]
                best = best[:k]
                out[0].append(np.full(len(best), ids[i]))
                out[1].append(own_id[here[best]])
                out[2].append(score[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        return pa.table({"query_id": join(out[0], pa.int64()), "vec_id": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the vectors that take part: not null, finite, not zero, of the most usual length (ties: the shorter)."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)
    usual = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(1)
    return rows.join(F.broadcast(usual.select("length")), F.size("v") == F.col("length"), "left_semi")  # one row


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, post: int = POST, opened: float = OPENED, share: float = SHARE, fewest: int = FEWEST
) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> query_id, rank, vec_id, score: each query's k best found by cosine.

    Queries: rows whose vec_id is divisible by `every`; candidates: every other row (a row that repeats the query's id
    counts as the query's own). Nearest first, ties to the smaller vec_id; fewer rows if there are fewer candidates.
    Rows that repeat a vec_id are one neighbour or one query with several vectors: the best score counts. Vectors that
    are null, zero, hold null or non-finite components or have another than the usual length take no part. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors), "ann-rows")
    n = rows.count()
    pivots = max(1, min(pivots, n // 4))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(1 << 20)) <= min(1.0, 4.0 * pivots / max(1, n)) * (1 << 20))
    sample = drawn.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(pivots).toArrow()
    if sample.num_rows < pivots:  # few ids have most rows: different vectors are drawn, whatever their ids
        sample = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("v", F.lit(7)), "vec_id").limit(pivots).select("vec_id", "v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    basis = _unit(_matrix(sample["v"]))
    pivots = len(basis)
    opens = min(pivots, max(LEAST_OPENED, int(np.ceil(opened * pivots))))
    prefix, post = min(prefix, pivots), min(post, pivots)
    length = max(prefix, post, opens)
    indexed = written(rows.mapInArrow(_orders(basis, length), StructType([*rows.schema.fields, StructField("perm", ArrayType(ShortType()))])), "ann-indexed")
    asked = indexed.filter(F.col("vec_id") % every == 0)
    files = lambda df, m: df.select("vec_id", "v", "perm", F.explode(F.slice("perm", 1, m)).alias("file"))
    count = lambda df, name: df.groupBy("file").agg(F.count(F.lit(1)).alias(name))
    blocks = count(files(indexed, post), "rows").join(count(files(asked, opens), "queries"), "file")
    blocks = written(blocks.select("file", F.ceil(F.col("rows") / FILE_ROWS).cast("int").alias("ni"), F.ceil(F.col("queries") / FILE_QUERIES).cast("int").alias("nj")), "ann-blocks")
    blocks = F.broadcast(blocks)  # a row for each pivot
    cell = F.xxhash64("vec_id", F.lit(9))
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["vec_id", "v", "perm"]
    data = files(indexed, post).join(blocks, "file").select("file", F.pmod(cell, F.col("ni")).cast("int").alias("i"), every_one("nj").alias("j"), *columns, F.lit(False).alias("is_query"))
    wanted = files(asked, opens).join(blocks, "file").select("file", every_one("ni").alias("i"), F.pmod(cell, F.col("nj")).cast("int").alias("j"), *columns, F.lit(True).alias("is_query"))
    search = _search(pivots, k, prefix, post, opens, share, fewest)
    found = written(data.unionByName(wanted).groupBy("file", "i", "j").applyInArrow(search, "query_id long, vec_id long, score double"), "ann-found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
