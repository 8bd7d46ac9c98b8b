"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of n-gram buckets by language are made on the executors and added up before the shuffle; the log-probability
matrix (languages x buckets, so of bounded size) is broadcast, and batches are scored by gathering its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import held_out

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Fit on at most about so many documents of each language, chosen by a hash of doc_id.
DOCS_PER_LANGUAGE = 6000
#: Characters of one pass; longer texts go through in pieces, whole.
PIECE = 1 << 20

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages


def _fold() -> np.ndarray:
    """Lower-cased code points of the first planes' letters; everything that is no letter becomes a space."""
    out = np.full(0x3000, 32, np.uint32)
    for i in range(0x3000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_FOLD = _fold()


def _buckets(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, word borders included, that hold a letter."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 0x3000, _FOLD[np.minimum(code, 0x2FFF)], code)
    code = np.concatenate((np.array([32], np.uint32), code, np.array([32], np.uint32)))
    letter = code != 32
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, n, np.uint32)
            some = np.zeros(len(h), bool)
            for i in range(n):
                part = code[i : len(code) - n + 1 + i]
                h = (h ^ part) * _MULTIPLIERS[i]
                h ^= h >> np.uint32(15)
                some |= letter[i : len(code) - n + 1 + i]
            out.append((h >> np.uint32(5))[some] & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def _pieces(text: str):
    for at in range(0, len(text), PIECE):
        yield text[max(0, at - max(ORDERS) + 1) : at + PIECE]


def _count(batches):
    """(text, lang) -> (lang, bucket, n), one row for each of a task's languages and buckets."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
            for piece in _pieces(text):
                counts[lang] += np.bincount(_buckets(piece), minlength=BUCKETS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, smoothing: float = 0.5, docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fit on docs(doc_id, text, lang): rows with text and lang that are not held out.

    At most about docs_per_language documents of each language are used, chosen by a hash of doc_id: the only bound
    here, and the same at every size. No usable row gives a model without languages, which predicts `und`.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    table = chosen.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(sizes))
    index = {x: i for i, x in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), smoothing)
    which = np.array([index[x] for x in table["lang"].to_pylist()], dtype=np.int64)
    counts[table["bucket"].to_numpy(), which] += table["n"].to_numpy()
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float) / sum(sizes.values()))
    return LanguageModel(languages, prior, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def score_texts(model: LanguageModel, col: pa.Array) -> tuple[list[str], np.ndarray]:
    """(predicted language, its posterior probability) of every text of a column."""
    n = len(col)
    usable = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    total = np.tile(model.log_prior, (n, 1))
    texts = col.to_pylist()
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def flush():
        if waiting:
            gathered = model.log_prob[np.concatenate(waiting)]
            ends = np.cumsum([len(w) for w in waiting])
            np.add.at(total, owners, np.add.reduceat(gathered, np.concatenate(([0], ends[:-1])), axis=0, dtype=np.float64))
            waiting.clear()
            owners.clear()

    size = 0
    for i in np.flatnonzero(usable) if model.languages else []:
        for piece in _pieces(texts[i]):
            b = _buckets(piece)
            if len(b):
                waiting.append(b)
                owners.append(i)
                size += len(b)
            if size > PIECE:
                flush()
                size = 0
    flush()
    if not model.languages:
        return ["und"] * n, np.zeros(n)
    best = total.argmax(axis=1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p = p[np.arange(n), best] / p.sum(axis=1)
    return [model.languages[b] if u else "und" for b, u in zip(best, usable)], np.where(usable, p, 0.0)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score; one row per input row.

    `und` with score 0 where the text is null or has no letter. Only the text is looked at, whole; ties go to the
    language that comes first by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lang, score = score_texts(m, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language predicted with at least this probability.

    Null texts and texts without a letter are rejected; a rejected row is one that has no language, whatever its lang
    column says.
    """
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lang, score = score_texts(shared.value, part.column(at))
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
