"""The text operators' queries, each applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm import align, ann, byte_bpe, html_extract, intervals, language_id, mixing, near_dedup, quality_model, quality_rules, secrets, sentencepiece_bpe, sharding
from codexlake.llm.common import held_out, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.token_digests(table(spark, sf_dir, "documents"), sentencepiece_bpe.default_model())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents")).drop("lang", "source", "distance2")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans ('start-end' of each finding in code points, joined by commas)."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("findings", lambda f: F.concat(f["start"].cast("string"), F.lit("-"), f["end"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), spans.alias("spans"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), *byte_bpe.default_ranks())


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), *align.default_files())


def op13_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sales_and_sessions(*(table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks")))


#: All links on full sets by a join over shared shingles, then components by minimum labels.
_NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i + 4], ' ')) AS g FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS r(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 75 * (x.n + y.n - common)),
d AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(node, root) AS (SELECT DISTINCT u, u FROM d UNION SELECT d.v, r.root FROM r JOIN d ON d.u = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, w.doc_id = coalesce(m.root, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (op1_html_extraction, op2_minhash_near_dedup, op3_sentencepiece, op4_quality_rules, op5_language_id, op6_permutation_index, op7_secret_scan, op8_sharding, op9_source_mixing, op10_quality_classifier, op11_byte_bpe, op12_token_alignment, op13_interval_join)
    return {f.__name__: f for f in all_of}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": _NEAR_DUPLICATES, "op4_quality_rules": quality_rules.oracle_sql(), "op9_source_mixing": mixing.ORACLE_SQL, "op13_interval_join": intervals.ORACLE_SQL}
