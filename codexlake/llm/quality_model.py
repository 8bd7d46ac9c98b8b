"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Words and runs of signs fall into hashed buckets, as they are written. A bucket's index vector is sparse and random; its
word vector is the sum of the index vectors around its occurrences in all documents. A text is pooled into the mean of
its word vectors and the mean of the products of neighbouring ones (how much a word is like the next). The network's
logit is divided by a temperature fitted on a calibration part of the labelled sample. Contexts are summed as whole
numbers and vectors held in 1/256 steps, so neither the order of tasks nor a batch's other rows touch a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import discard, held_out, word_hashes, written

BUCKETS, DIMENSIONS, NONZERO = 1 << 14, 64, 6
#: Labelled documents of either label that the model is fitted on, at most about; chosen by a hash of doc_id.
SAMPLE = 4000
HIDDEN = 32
#: Weights of words one, two and three apart.
NEAR = (6, 3, 2)
#: Tokens whose contexts are added up at once, and pooled at once.
CHUNK, GROUP = 1 << 20, 1 << 13
#: Parts of the table of vectors; sums of so many tasks are merged by one.
SLICES, FAN = 16, 64
#: Steps of a unit that vectors are held in; sums over a group of tokens fit 32 bits.
GRID = 256


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray  # buckets x dimensions, whole numbers of 1/GRID
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where and with which sign every bucket's sparse index vector is not zero, always the same."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


#: Kinds of bytes that a word is cut between: signs of ASCII apart from letters, digits and all beyond ASCII.
_KINDS = np.array([int(i < 128 and not chr(i).isalnum()) for i in range(256)], np.uint8)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, end of each row among them) of every word and every run of signs, row by row."""
    words, ends = word_hashes(col, fold=False, kinds=_KINDS)
    return (words >> np.uint64(20)).astype(np.int64) % BUCKETS, ends


def pooled(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector and mean product of neighbouring vectors of each row (zeros without words)."""
    flat, ends = tokens(col)
    starts = np.concatenate(([0], ends[:-1]))
    d = vectors.shape[1]
    total = np.zeros((len(ends), 2 * d), np.int64)
    some = np.flatnonzero(ends > starts)
    for at in range(0, len(flat), GROUP):  # groups of a bounded number of tokens, whatever the rows; sums are exact
        stop = min(len(flat), at + GROUP)
        rows = some[(starts[some] < stop) & (ends[some] > at)]
        v = vectors[flat[at : min(len(flat), stop + 1)]].astype(np.int32)
        begin = np.maximum(starts[rows], at) - at
        total[rows, :d] += np.add.reduceat(v[: stop - at], begin, axis=0)
        pair = v[:-1] * v[1:]
        last = ends[rows] - 1 - at  # a row's last token has no neighbour
        pair[last[last < len(pair)]] = 0
        if len(pair):
            fits = begin < len(pair)
            total[rows[fits], d:] += np.add.reduceat(pair, begin[fits], axis=0)
    n = np.maximum(1, ends - starts)[:, None]
    out = total / np.concatenate((np.full(d, GRID), np.full(d, GRID * GRID))) / n
    return out


def _around(flat: np.ndarray, row: np.ndarray, total: np.ndarray) -> None:
    """Add the index vectors around every token to its bucket's sum."""
    at, sign = index_vectors()
    for gap, weight in enumerate(NEAR, 1):
        same = row[gap:] == row[:-gap]
        a, b = flat[:-gap][same], flat[gap:][same]
        for x, y in ((a, b), (b, a)):
            for k in range(NONZERO):
                total += (weight * np.bincount(x * DIMENSIONS + at[y, k], weights=sign[y, k], minlength=len(total))).astype(np.int64)


def _packed(total: np.ndarray):
    """Sums -> a batch of (slice, buckets, sums), used buckets only."""
    table = total.reshape(BUCKETS, DIMENSIONS)
    used = np.flatnonzero(table.any(axis=1))
    width = BUCKETS // SLICES
    rows = [(s, used[used // width == s]) for s in range(SLICES)]
    rows = [(s, u) for s, u in rows if len(u)]
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in rows], pa.int32()), pa.array([u.astype(np.int32).tobytes() for _, u in rows], pa.binary()), pa.array([_small(table[u]).tobytes() for _, u in rows], pa.binary())],
        names=["slice", "buckets", "sums"],
    )


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if np.abs(x).max(initial=0) < 1 << 31 else x


def _unpacked(total: np.ndarray, buckets: bytes, sums: bytes) -> None:
    at = np.frombuffer(buckets, np.int32)
    total.reshape(BUCKETS, DIMENSIONS)[at] += np.frombuffer(sums, np.int32 if len(sums) == 4 * DIMENSIONS * len(at) else np.int64).reshape(len(at), DIMENSIONS)


_SUMS = "slice int, buckets binary, sums binary"


def _contexts(batches):
    """Texts -> this task's sums of index vectors around every bucket."""
    total = np.zeros(BUCKETS * DIMENSIONS, np.int64)
    flats, rows, waiting, n = [], [], 0, 0

    def flush():
        if waiting:
            _around(np.concatenate(flats), np.concatenate(rows), total)
            flats.clear()
            rows.clear()

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            flat, ends = tokens(batch.column(0).slice(i, 256))
            flats.append(flat)
            rows.append(n + np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends)))))
            n += len(ends)
            waiting += len(flat)
            if waiting >= CHUNK:
                flush()
                waiting = 0
    flush()
    if total.any():
        yield _packed(total)


def _merged(batches):
    """Sums of many tasks -> their total."""
    total = np.zeros(BUCKETS * DIMENSIONS, np.int64)
    for batch in batches:
        for buckets, sums in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            _unpacked(total, buckets, sums)
    if total.any():
        yield _packed(total)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all buckets from the texts of all docs, as whole numbers of 1/GRID.

    Tasks give sums of bounded size, which are merged FAN at a time on the executors; the driver gets one table.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    parts, sums = texts.rdd.getNumPartitions(), texts.mapInArrow(_contexts, _SUMS)
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(_merged, _SUMS)
    total = np.zeros(BUCKETS * DIMENSIONS, np.int64)
    for row in sums.repartition(SLICES, "slice").mapInArrow(_merged, _SUMS).toArrow().to_pylist():
        _unpacked(total, row["buckets"], row["sums"])
    vectors = total.reshape(BUCKETS, DIMENSIONS).astype(np.float64)
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    vectors = np.where(length > 0, vectors / np.maximum(length, 1e-9), 0)
    used = length[:, 0] > 0
    if used.any():
        vectors[used] -= vectors[used].mean(axis=0)
    return np.rint(vectors * GRID).astype(np.int16)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple:
    """Train by Adam on the larger part, choose the temperature on the rest."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5) if len(y) >= 10 else 0
    cal, fit = order[:cut], order[cut:]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    w1 = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN))
    b1, w2, b2 = np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
    params = [w1, b1, w2, b2]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    zf, yf = z[fit], y[fit]
    for step in range(1, 401):
        h = np.tanh(zf @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40)))
        g = (p - yf) / len(yf)
        back = np.outer(g, w2) * (1 - h * h)
        grads = [zf.T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ g + 1e-4 * w2, np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            params[i] -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(z[cal] @ w1 + b1) @ w2 + b2
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.5), np.log(8), 60)) if cut else []:
        q = np.clip(1 / (1 + np.exp(-np.clip(logit / t, -40, 40))), 1e-9, 1 - 1e-9)
        best = min(best, (float(-(y[cal] * np.log(q) + (1 - y[cal]) * np.log(1 - q)).mean()), float(t)))
    return mean, scale, w1, b1, w2, float(b2[0]), best[1]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all texts of docs(doc_id, text); the network from labels(doc_id, quality) that are not held out.

    At most about `sample` documents of either label are used for the network, chosen by a hash of doc_id: the only
    bound here, the same at every size. A doc_id with both labels counts for neither; rows without a label or text are
    left out; without any labelled row every score is 0.5.
    """
    y = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    sizes = {r["quality"]: r["n"] for r in y.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[v for k in (0, 1) for v in (F.lit(k), F.lit(min(1.0, sample / max(1, sizes.get(k, 0)))))])
    y = y.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(1 << 20)) < share[F.col("quality")] * (1 << 20))
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string")).filter("text IS NOT NULL").join(F.broadcast(y), "doc_id")  # about 2 * sample labels
    kept = written(rows.select("doc_id", "text", "quality"), "quality-sample")
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = pooled(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    got = kept.mapInArrow(pool, "doc_id long, quality int, x binary").toArrow()
    discard(kept)
    if not got.num_rows:
        zero = np.zeros(2 * DIMENSIONS)
        return QualityModel(vectors, zero, zero + 1, np.zeros((2 * DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    found = sorted(zip(got["doc_id"].to_pylist(), got["x"].to_pylist(), got["quality"].to_pylist()))
    return QualityModel(vectors, *_fit(np.stack([np.frombuffer(r) for _, r, _ in found]), np.array([q for *_, q in found], dtype=float)))


def score_texts(model: QualityModel, col: pa.Array) -> np.ndarray:
    """Calibrated probability of label 1 for each text."""
    x = (pooled(col, model.vectors) - model.mean) / model.scale
    logit = np.tanh(x @ model.w1 + model.b1) @ model.w2 + model.b2
    return 1 / (1 + np.exp(-np.clip(logit / model.temperature, -40, 40)))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score; one row per input row.

    Null and empty texts have no words: they get the score of the zero vector. Only the text is looked at, whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(shared.value, part.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
