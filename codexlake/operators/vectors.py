"""Dense search: exact cosine against given queries, topics by k-means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_similar(vectors: DataFrame, query: DataFrame, n: int, id_col: str = "vec_id", vector: str = "embedding", condition: Column | None = None) -> DataFrame:
    """id, score of the n rows nearest to the single query row, itself left out; metadata filters come first.

    The query is one row and broadcast; every task keeps a heap of n rows.
    """
    q = query.select(F.col(id_col).alias("_qid"), F.col(vector).alias("_q")).limit(1)
    rows = vectors if condition is None else vectors.filter(condition)
    x = rows.join(F.broadcast(q)).filter(F.col(id_col) != F.col("_qid"))
    return x.select(id_col, cosine(F.col(vector), F.col("_q")).alias("score")).orderBy(F.desc("score"), id_col).limit(n)


#: Queries that top_for_queries takes at once: their matrix goes to every task.
MOST_QUERIES = 20_000


def top_for_queries(vectors: DataFrame, queries: DataFrame, n: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """qid, id, score, rank: for each of the stated queries(qid, vector) the n rows of largest cosine (to nine digits), ties by id.

    All rows meet the queries in blocks: a task compares a batch of rows with the matrix of queries and passes on n of them
    a query. Vectors that are null, of zero length or of another dimension take no part. More than MOST_QUERIES are refused.
    """
    import numpy as np
    import pyarrow as pa

    asked = queries.select("qid", F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    size = max((len(r.v) for r in asked), default=0)
    asked = [r for r in asked if len(r.v) == size and any(r.v)]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    matrix = unit(np.array([r.v for r in asked])) if asked else np.zeros((0, size))
    qids = [r.qid for r in asked]
    types = {"qid": dict(queries.dtypes)["qid"], id_col: dict(vectors.dtypes)[id_col]}

    def run(batches):
        for batch in batches:
            ids, flat = batch.column(0), batch.column(1)
            if not len(ids) or not len(qids):
                continue
            score = np.round(matrix @ unit(flat.flatten().to_numpy().reshape(len(ids), size)).T, 9)
            order = np.argsort(np.argsort(np.array(ids.to_pylist()), kind="stable"), kind="stable")
            for i, qid in enumerate(qids):
                best = np.lexsort((order, -score[i]))[:n]
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(best)), ids.take(pa.array(best)), pa.array(score[i][best])], names=["qid", id_col, "score"])

    rows = vectors.select(id_col, F.col(vector).cast("array<double>").alias("v")).filter((F.size("v") == size) & F.exists("v", lambda x: x != 0))
    found = rows.mapInArrow(run, f"qid {types['qid']}, {id_col} {types[id_col]}, score double")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", place).filter(F.col("rank") <= n)


def embedding_text() -> Column:
    """Title twice, 1500 characters of abstract, 15 keywords, venue, three families."""
    people = F.array_join(F.slice(F.transform("authors", lambda a: a["family"]), 1, 3), " ")
    return F.concat_ws(" ", "title", "title", F.substring("abstract", 1, 1500), F.array_join(F.slice("keywords", 1, 15), " "), "journal", people)


def topics(vectors: DataFrame, k: int, seed: int = 0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, topic by k-means (seeded; topic numbers by falling size)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    out = KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select(id_col, F.col("prediction").alias("_c"))
    from pyspark.sql import Window

    sizes = out.groupBy("_c").agg(F.count(F.lit(1)).alias("n"))  # k rows
    order = sizes.select("_c", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "_c")) - 1).alias("topic"))
    return out.join(F.broadcast(order), "_c").select(id_col, "topic")
