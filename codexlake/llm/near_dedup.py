"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

How it scales. Texts of one shingle set form a class and only its representative goes on. A bucket (one band's key)
never meets in one task: its two leaders are found by a combined aggregate, and each member is paired with them. What
leaders do not connect is compared within its buckets on full shingle sets, in blocks of bounded size, between different
components only; a block gives back a forest of links. So no link between candidates is lost, and no group of copies is
expanded into its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import discard, written
from codexlake.llm.components import components, union_find
from codexlake.llm.shingles import band_keys, set_digest, shingle_sets, signatures, similarity

#: 32 bands of 4 rows: a pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.
SLOTS, ROWS = 128, 4
#: Members of a bucket on either side of one block comparison.
BLOCK = 256
#: Rows of a batch worked on at once.
STEP = 512

_SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"


def _sketches(shingle: int, with_text: bool = False):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                sets = shingle_sets(part.column(1), shingle)
                sig = signatures(sets, SLOTS)
                keys = band_keys(sig, ROWS)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                columns = [part.column(0), pa.array(size), pa.array([set_digest(s) for s in sets], pa.binary()), bands]
                names = ["doc_id", "n_shingles", "digest", "bands"]
                yield pa.RecordBatch.from_arrays([*columns, part.column(1)] if with_text else columns, names=[*names, "text"] if with_text else names)

    return run


def _verify(shingle: int, percent: int):
    """(a, b, text_a, text_b) -> the pairs whose full sets reach percent."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                new: dict[int, int] = {}
                for i, key in enumerate(a):
                    if key not in known:
                        new.setdefault(key, i)
                if len(known) > 2 * STEP:
                    known = {k: known[k] for k in set(a) if k in known}
                if new:
                    known |= zip(new, shingle_sets(part.column(2).take(pa.array(list(new.values()))), shingle))
                right = shingle_sets(part.column(3), shingle)
                keep = []
                for i, (x, y) in enumerate(zip(a, right)):
                    s = known[x]
                    if 100 * min(len(s), len(y)) < percent * max(len(s), len(y)):
                        continue
                    same, either = similarity(s, y)
                    if either and 100 * same >= percent * either:
                        keep.append(i)
                yield part.select([0, 1]).take(pa.array(keep, pa.int64())).rename_columns(["u", "v"])

    return run


def _block_links(shingle: int, percent: int):
    """One block of a bucket: probes against members of other components on full sets; a spanning forest of the links.

    Only sizes that cannot reach the threshold are passed over. A pair is looked at only in the bucket of the first band
    it shares. Shingles are numbered in the block, so a probe's overlaps with all members are counted in one pass.
    """

    def run(cell: pa.Table) -> pa.Table:
        probe = cell["probe"].to_numpy()
        key = cell["key"][0].as_py()
        cid, comp, n = (cell[c].to_numpy() for c in ("cid", "component", "n"))
        bands = cell["bands"].combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        rows = np.flatnonzero(~probe)
        fits: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(probe).tolist() if len(rows) else ():
            fit = rows[(comp[rows] != comp[i]) & (100 * np.minimum(n[rows], n[i]) >= percent * np.maximum(n[rows], n[i]))]
            if len(fit):
                fit = fit[bands[i][(bands[fit] == bands[i]).argmax(axis=1)] == key]
            if len(fit):
                fits[i] = fit
        if not fits:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        members = np.unique(np.concatenate(list(fits.values())))
        needed = np.union1d(members, np.array(list(fits)))
        sets = dict(zip(needed.tolist(), shingle_sets(cell["text"].combine_chunks().take(pa.array(needed)), shingle)))
        sizes = np.array([len(sets[m]) for m in members.tolist()])
        names, flat = np.unique(np.concatenate([sets[m] for m in members.tolist()]), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        left, right = [], []
        has = np.zeros(len(names), np.int32)
        for i, fit in fits.items():
            at = np.searchsorted(names, sets[i])
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == sets[i])]
            has[at] = 1
            same = np.add.reduceat(has[flat], starts)
            has[at] = 0
            j = np.searchsorted(members, fit)
            fit = fit[100 * same[j] >= percent * (sizes[j] + len(sets[i]) - same[j])]
            left.append(np.full(len(fit), i))
            right.append(fit)
        left, right = np.concatenate(left), np.concatenate(right)
        nodes, root = union_find(cid[left], cid[right])
        return pa.table({"u": pa.array(nodes[nodes != root], pa.int64()), "v": pa.array(root[nodes != root], pa.int64())})

    return run


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """pairs(a, b) of doc ids whose texts reach the threshold, as written edges(u, v)."""
    pairs = written(pairs.distinct(), f"{name}-pairs")
    # merge joins at every size: the plan does not flip with the input, and skewed ids are split
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(docs.join(ids.hint("merge"), "doc_id").select("doc_id", "text"), f"{name}-texts")
    both = pairs.join(texts.toDF("a", "text_a").hint("merge"), "a").join(texts.toDF("b", "text_b").hint("merge"), "b").select("b", "a", "text_b", "text_a")
    edges = written(both.mapInArrow(_verify(shingle, percent), "u long, v long"), f"{name}-edges")
    discard(texts)
    discard(pairs)
    return edges


def _one_document(full: DataFrame, classes: DataFrame) -> DataFrame:
    """edges(u, v) between the classes that one doc_id has rows in."""
    several = full.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id")
    of = written(full.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(classes.select("digest", "cid"), "digest").select("doc_id", "cid"), "nd-repeated-ids")
    return of.join(of.groupBy("doc_id").agg(F.min("cid").alias("v")), "doc_id").filter("cid <> v").select(F.col("cid").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: one row per input row.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| on their sets of distinct shingles.
    component_id is the smallest doc_id reachable over links; kept is doc_id = component_id.
    Null or wordless texts have an empty set, are linked with nothing and are kept. Fewer words than a shingle: the
    whole sequence is the one element. Rows that repeat a doc_id are one document for linking and each gets a row; a
    null doc_id is linked with nothing (component_id and kept null). Other columns are ignored, and an empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(docs.mapInArrow(_sketches(shingle), _SKETCH), "nd-sketch")
    full = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("copies")), "nd-classes")
    rep = classes.select("cid").distinct()
    members = full.select(F.col("doc_id").alias("cid"), "n_shingles", "bands").join(rep, "cid")
    keys = members.select("cid", F.explode("bands").alias("key"))
    rank = F.struct(F.xxhash64("cid"), F.col("cid"))
    leaders = written(keys.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("z"), F.min(rank)["cid"].alias("b")).filter("a <> z").drop("z"), "nd-leaders")
    shared = written(keys.join(leaders, "key").select("key", "cid", "a", "b"), "nd-shared")
    stars = shared.select("cid", F.explode(F.array("a", "b")).alias("to")).filter("cid <> to")
    edges = _verified(docs, stars.select(F.least("cid", "to").alias("a"), F.greatest("cid", "to").alias("b")), shingle, percent, "nd-star").unionByName(_one_document(full, classes))
    comp = written(components(edges), "nd-comp")
    shared_comp = shared.select("key", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("component"))
    # buckets that hold several components still, each one's members by component
    per = shared_comp.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    open_keys = written(
        per.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("total"), F.max(F.struct("size", "component")).alias("top")).filter("parts > 1")
        .select("key", F.col("top.component").alias("main"), F.ceil(F.col("total") / BLOCK).cast("int").alias("nm"), F.ceil((F.col("total") - F.col("top.size")) / BLOCK).cast("int").alias("np")),
        "nd-open",
    )
    if not open_keys.isEmpty():
        rest = shared_comp.join(open_keys, "key")
        ids = rest.select(F.col("cid").alias("doc_id")).distinct()
        again = docs.join(ids.hint("merge"), "doc_id").select("doc_id", "text").mapInArrow(_sketches(shingle, True), _SKETCH + ", text string").filter("n_shingles > 0")
        texts = written(again.select(F.col("doc_id").alias("cid"), "digest", F.col("n_shingles").alias("n"), "bands", "text").dropDuplicates(["cid", "digest"]).drop("digest"), "nd-rest-texts")
        rest = rest.join(texts.hint("merge"), "cid")
        cell = F.xxhash64("cid", F.lit(1))
        columns = ["cid", "component", "n", "bands", "text"]
        as_member = rest.select("key", F.pmod(cell, F.col("nm")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("j"), *columns, F.lit(False).alias("probe"))
        as_probe = rest.filter("component <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("i"), F.pmod(cell, F.col("np")).cast("int").alias("j"), *columns, F.lit(True).alias("probe"))
        parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in comparing, not in bytes
        more = written(as_member.unionByName(as_probe).repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(_block_links(shingle, percent), "u long, v long"), "nd-rest-edges")
        discard(texts)
        if not more.isEmpty():
            comp = written(components(edges.unionByName(more)), "nd-comp")
    named = written(classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("digest", F.coalesce("component", "cid").alias("component_id")), "nd-named")
    out = sketch.join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
