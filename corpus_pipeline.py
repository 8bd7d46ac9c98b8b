"""A corpus pipeline: language ID, near-dedup, secret scan, mixing, tokenization.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents but
for the last, which returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix. run() writes every
stage's result as Parquet into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm import language_id, mixing, near_dedup, secrets, sentencepiece_bpe
from codexlake.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts, texts without a letter, undecided predictions."""
    return language_id.accepted(docs, language_id.train(docs))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, written so that it stays, and that column's name."""
    key = "row"
    while key in docs.columns:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of smallest doc_id (null last).

    Rows are compared, not ids: repeated rows become one, different texts under one doc_id both stay, and rows without
    a doc_id take part like others.
    """
    rows, key = keyed(docs)
    groups = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key).alias("row")))
    stay = groups.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(key))
    return rows.join(stay, key, "left_semi").select(docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, n_chars follows; no document goes."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0 to 2), so that sources reach their target weights."""
    rows, key = keyed(docs)
    copies = mixing.mix(rows, carry=(key,)).filter("copies > 0").select(key, F.sequence(F.lit(1), F.col("copies")).alias("times"))
    taken = rows.alias("d").join(copies.alias("c"), F.col(f"d.{key}") == F.col(f"c.{key}"))
    return taken.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode("c.times").alias(key)).drop(key)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.token_digests(docs, sentencepiece_bpe.default_model(), keep_caches=False)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", remove_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Language models and tokenization can't be said in SQL. Tests check each stage's rows and counts against the one before;
#: the operators themselves are held against brute force, all but language ID.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
