"""A kept full-text index of passages: segments on disk, bucketed by term, searched block by block.

A segment holds, for every term and window of neighbouring passages, one block: where in the window the term occurs and
how often, and the largest count and the smallest length among these passages, which bound what the block can add to any
score. A window's lengths and references are stored once, not in its blocks. Blocks lie in folders by a hash of the term,
so a search reads the folders of its own terms only. A search for the k best adds up the bounds of each window, scores
the most promising windows first, and then only those whose bound reaches the k-th score found. A window's blocks come
together in one task, each once for all queries, and scores are added up there.

Changed references go into a new segment, beside a list of the passages that they replace and what those had added to the
statistics; compaction writes one segment of what is alive. A manifest names the segments that count.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.operators.search import K1, B, tokens
from codexlake.sources.manifest import Manifest
from codexlake.sources.tables import settled

#: Bits of a passage number that count within a window; windows of a query that are scored before the others.
WINDOW_BITS, SEEDS = 11, 3
#: Distinct query terms up to which they are pushed into the scan.
PUSHED_TERMS = 1000
#: Pairs of a query and a term up to which they, and what is one row a query, go to every task.
SENT_TERMS = 100_000


def word_passages(docs: DataFrame, ref: str, text: str, size: int) -> DataFrame:
    """docs -> ref_id, ord, text: runs of so many white-space separated words, the last one shorter; none for a text without words."""
    ws = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("ws") / size).cast("int") - 1), lambda i: F.array_join(F.slice("ws", i * size + 1, F.lit(size)), " "))
    return docs.select(F.col(ref).alias("ref_id"), ws.alias("ws")).filter(F.size("ws") > 0).select("ref_id", F.posexplode(runs).alias("ord", "text"))


def _weight(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _at(pid: Column) -> Column:
    """A passage's place in its window."""
    return pid.bitwiseAND(F.lit((1 << WINDOW_BITS) - 1)).cast("int")


def _gone(at: Column) -> Column:
    """Whether the place is marked in the column `gone` of _marks; a window without marks has null there."""
    return F.coalesce(F.getbit(F.get("gone", F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1, F.lit(False))


def _marks(passages: DataFrame) -> DataFrame:
    """passages(segment, pid) -> segment, window, gone: a bit a place, in an array of longs."""
    at = _at(F.col("pid"))
    each = passages.select("segment", F.shiftright("pid", WINDOW_BITS).alias("window"), F.shiftright(at, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63))).alias("bit"))
    slots = each.groupBy("segment", "window", "slot").agg(F.bit_or("bit").alias("bits")).groupBy("segment", "window").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("m"))
    return slots.select("segment", "window", F.transform(F.sequence(F.lit(0), F.lit((1 << WINDOW_BITS >> 6) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("gone"))


class PassageIndex:
    """The index at a path (on a cluster: one that all machines share). Passages are ref_id, ord, text."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    # ---- state

    def _state(self) -> tuple[int, dict]:
        number, content = self.manifest.newest()
        return number, content or {"segments": [], "buckets": self.buckets, "ref": None}

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(state["buckets"])).cast("int").alias("bucket")

    def _read(self, state: dict, part: str, segments: Sequence[str] | None = None) -> DataFrame:
        """One part of all segments; the segment's name is a column."""
        ref = state["ref"]
        schema = {
            "passages": f"pid long, ref_id {ref}, ord int, text string", "dead": "seg string, pid long, dl int", "terms": "term string, df long, bucket int",
            "windows": f"window long, lengths array<int>, refs array<struct<ref_id:{ref},ord:int>>",
            "blocks": "term string, window long, most int, shortest int, at array<smallint>, tf array<int>, bucket int",
        }[part]
        names = [s["name"] for s in state["segments"]] if segments is None else segments
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/{n}/{part}").withColumn("segment", F.lit(n)) for n in names]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], schema + ", segment string")

    def _dead(self, state: dict) -> DataFrame:
        return _marks(self._read(state, "dead").select(F.col("seg").alias("segment"), "pid"))

    def live(self, state: dict | None = None) -> DataFrame:
        """segment, pid, ref_id, ord, text of the passages that count."""
        state = state or self._state()[1]
        rows = self._read(state, "passages").withColumn("window", F.shiftright("pid", WINDOW_BITS))
        return rows.join(self._dead(state), ["segment", "window"], "left").filter(~_gone(_at(F.col("pid")))).select("segment", "pid", "ref_id", "ord", "text")

    def _places(self, state: dict) -> DataFrame:
        """segment, window, at, ref_id, ord, dl of all passages, without texts."""
        return self._read(state, "windows").select("segment", "window", F.posexplode(F.arrays_zip("refs", "lengths")).alias("at", "x")).select("segment", "window", "at", "x.refs.*", F.col("x.lengths").alias("dl"))

    # ---- writing

    def upsert(self, passages: DataFrame, removed: DataFrame | None = None) -> int:
        """Add passages as a new segment; those that the same references had go, and those of removed(ref_id). The manifest's number."""
        number, state = self._state()
        state["ref"] = state["ref"] or dict(passages.dtypes)["ref_id"]
        name = self._segment(passages, state)
        touched = passages.select("ref_id")
        if removed is not None:
            touched = touched.unionByName(removed.select("ref_id"))
        self._bury(name, touched.distinct(), state)
        return self._commit(name, state, number, keep=True)

    def remove(self, refs: DataFrame) -> int:
        """Take references(ref_id) out."""
        state = self._state()[1]
        return self.upsert(self.spark.createDataFrame([], f"ref_id {state['ref'] or 'string'}, ord int, text string"), refs)

    def compact(self) -> int:
        """One segment of all live passages in place of the segments; readers of the old ones are not disturbed."""
        number, state = self._state()
        name = self._segment(self.live(state).select("ref_id", "ord", "text"), state)
        self._bury(name, None, state)
        return self._commit(name, state, number, keep=False)

    def _segment(self, passages: DataFrame, state: dict) -> str:
        """Write passages and blocks. Passages get their numbers when they are written, blocks are made of what was written."""
        name = f"segment-{uuid.uuid4().hex}"
        passages.select(F.monotonically_increasing_id().alias("pid"), "ref_id", F.col("ord").cast("int").alias("ord"), "text").write.option("compression", "zstd").parquet(f"{self.path}/{name}/passages")
        rows = self._read(state, "passages", [name]).select(F.shiftright("pid", WINDOW_BITS).alias("window"), _at(F.col("pid")).cast("smallint").alias("at"), "ref_id", "ord", "text")
        each = F.sort_array(F.collect_list(F.struct("at", "dl", "ref_id", "ord")))
        windows = rows.select("window", "at", F.size(tokens(F.col("text"))).alias("dl"), "ref_id", "ord").groupBy("window").agg(each.alias("docs")).select("window", F.col("docs.dl").alias("lengths"), F.transform("docs", lambda d: F.struct(d["ref_id"].alias("ref_id"), d["ord"].alias("ord"))).alias("refs"))
        windows.write.parquet(f"{self.path}/{name}/windows")
        # a window's texts come together once; counts and blocks are then made where they are
        ws = rows.select("window", "at", "text").repartition("window").select("window", "at", tokens(F.col("text")).alias("ws"))
        words = ws.select("window", "at", F.size("ws").alias("dl"), F.explode("ws").alias("term"))
        counted = words.groupBy("window", "term", "at").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))
        docs = F.sort_array(F.collect_list(F.struct("at", "tf"))).alias("docs")
        blocks = counted.groupBy("window", "term").agg(F.max("tf").alias("most"), F.min("dl").alias("shortest"), docs)
        blocks = blocks.select("term", "window", "most", "shortest", F.col("docs.at").alias("at"), F.col("docs.tf").alias("tf"), self._bucket(state))
        # by ranges, so that the blocks of a frequent term are dealt to many tasks and files
        blocks = blocks.repartitionByRange("bucket", "term", "window").sortWithinPartitions("bucket", "term", "window")
        blocks.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}/blocks")
        return name

    def _bury(self, name: str, refs: DataFrame | None, state: dict) -> None:
        """Write which older passages the segment replaces, and what it adds to and takes from the terms' counts."""
        terms = self._read(state, "blocks", [name]).groupBy("term").agg(F.sum(F.size("at")).alias("df"))
        if refs is None or not state["segments"]:
            gone = self.spark.createDataFrame([], "seg string, pid long, dl int")
        else:
            there = self._places(state).join(self._dead(state), ["segment", "window"], "left").filter(~_gone(F.col("at")))
            gone = there.join(refs, "ref_id", "left_semi").select(F.col("segment").alias("seg"), (F.shiftleft("window", WINDOW_BITS) + F.col("at")).alias("pid"), "dl")
        gone.write.parquet(f"{self.path}/{name}/dead")
        if state["segments"]:
            marks = _marks(self._read(state, "dead", [name]).select(F.col("seg").alias("segment"), "pid"))
            hit = F.size(F.filter("at", lambda a: _gone(a.cast("int"))))
            lost = self._read(state, "blocks").select("segment", "window", "term", "at").join(marks, ["segment", "window"]).select("term", hit.alias("n"))
            terms = terms.unionByName(lost.groupBy("term").agg((-F.sum("n")).alias("df")).filter("df < 0"))
        both = terms.groupBy("term").agg(F.sum("df").alias("df")).withColumn("bucket", self._bucket(state))
        both.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{name}/terms")

    def _commit(self, name: str, state: dict, number: int, keep: bool) -> int:
        length = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
        added = self._read(state, "windows", [name]).agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)), F.coalesce(F.sum(length), F.lit(0))).first()
        lost = self._read(state, "dead", [name]).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        one = {"name": name, "passages": added[0] - lost[0], "length": added[1] - lost[1]}
        state["segments"] = [*state["segments"], one] if keep else [one]
        return self.manifest.commit(state, number)

    # ---- searching

    def _plan(self, queries: DataFrame) -> tuple[DataFrame, float, dict]:
        """(blocks of the queries' terms with asked: qid and idf of each, mean length, state); only folders of these terms are read."""
        state = self._state()[1]
        n, length = (sum(s[k] for s in state["segments"]) for k in ("passages", "length"))
        want = queries.select("qid", "term").distinct().withColumn("bucket", self._bucket(state))
        state["few"] = want.limit(SENT_TERMS + 1).count() <= SENT_TERMS
        mine = F.col("bucket").isin([r[0] for r in want.select("bucket").distinct().collect()])
        few = [r[0] for r in want.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        if len(few) <= PUSHED_TERMS:
            mine = mine & F.col("term").isin(few)
        df = self._read(state, "terms").filter(mine).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = want.drop("bucket").join(df, "term").groupBy("term").agg(F.collect_list(F.struct("qid", idf.alias("idf"))).alias("asked"))
        return self._read(state, "blocks").filter(mine).drop("bucket").join(self._sent(asked, state), "term"), max(length / n if n else 1.0, 1e-9), state

    def _sent(self, df: DataFrame, state: dict) -> DataFrame:
        return F.broadcast(df) if state["few"] else df

    def _scored(self, blocks: DataFrame, mean: float, state: dict, wanted: DataFrame | None = None) -> DataFrame:
        """qid, segment, window, at, score, matched of the live passages in the blocks, or in the windows that are wanted(qid, segment, window)."""
        if wanted is not None:
            by_window = wanted.groupBy("segment", "window").agg(F.collect_set("qid").alias("qids"))
            blocks = blocks.join(by_window, ["segment", "window"]).withColumn("asked", F.filter("asked", lambda q: F.array_contains("qids", q["qid"]))).drop("qids").filter(F.size("asked") > 0)
        together = blocks.select("segment", "window", "at", "tf", "asked").repartition("segment", "window")
        x = together.join(self._read(state, "windows").select("segment", "window", "lengths"), ["segment", "window"]).join(self._dead(state), ["segment", "window"], "left")
        one = lambda z: F.struct(z["at"].alias("at"), _weight(z["tf"], F.get("lengths", z["at"].cast("int")), mean).alias("w"))
        alive = F.filter(F.arrays_zip("at", "tf"), lambda z: F.col("gone").isNull() | ~_gone(z["at"].cast("int")))
        hits = x.select("segment", "window", "asked", F.transform(alive, one).alias("docs")).select("segment", "window", "docs", F.inline("asked")).select("segment", "window", "qid", "idf", F.inline("docs"))
        return hits.groupBy("segment", "window", "qid", "at").agg(F.sum(F.col("idf") * F.col("w")).alias("score"), F.count(F.lit(1)).alias("matched"))

    def _named(self, hits: DataFrame, state: dict) -> DataFrame:
        """hits with ref_id and ord in place of the passages' places."""
        at = ["segment", "window", "at"]
        return hits.join(self._places(state).drop("dl"), at).drop(*at)

    def scores(self, queries: DataFrame) -> DataFrame:
        """queries(qid, term) -> qid, ref_id, ord, score, matched: BM25 of every passage with any of the terms."""
        blocks, mean, state = self._plan(queries)
        return self._named(self._scored(blocks, mean, state), state).select("qid", "ref_id", "ord", "score", "matched")

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best passages of every query as scores gives them, with rank; ties (to nine digits) by ref_id and ord.

        Windows whose bound cannot reach the k-th best score of those scored first are left unread beyond their bounds.
        """
        blocks, mean, state = self._plan(queries)
        bounds, first = self._bounds(blocks, mean)
        found = settled(self._best(self._scored(blocks, mean, state, first), k))
        bar = self._bar(found, k)
        more = self._scored(blocks, mean, state, self._beyond(bounds, first, bar))
        more = more.join(self._sent(bar, state), "qid", "left").filter(F.col("bar").isNull() | (F.col("score") >= F.col("bar"))).drop("bar")
        named = self._named(self._best(found.unionByName(more), k), state)
        order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "ref_id", "ord")
        return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "ref_id", "ord", "score", "matched", "rank")

    def _best(self, hits: DataFrame, k: int) -> DataFrame:
        """The k best of every query, and all that tie with the last of them."""
        return hits.withColumn("_r", F.rank().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc()))).filter(F.col("_r") <= k).drop("_r")

    def _bar(self, found: DataFrame, k: int) -> DataFrame:
        """qid, bar: what a passage must reach to be among the k best; none for a query with fewer passages found."""
        return found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), (F.min("score") - 2e-9).alias("bar")).filter(F.col("n") >= k).select("qid", "bar")

    def _bounds(self, blocks: DataFrame, mean: float) -> tuple[DataFrame, DataFrame]:
        """(qid, segment, window, bound), and of these the ones to score first."""
        each = blocks.select("segment", "window", _weight(F.col("most"), F.col("shortest"), mean).alias("w"), F.inline("asked"))
        bounds = settled(each.groupBy("qid", "segment", "window").agg(F.sum(F.col("idf") * F.col("w")).alias("bound")))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "window"))
        return bounds, bounds.withColumn("place", place).filter(F.col("place") <= SEEDS).drop("place")

    def _beyond(self, bounds: DataFrame, first: DataFrame, bar: DataFrame) -> DataFrame:
        """Windows not scored yet that may hold a passage at the bar or above; all of a query that has no k passages yet."""
        left = bounds.join(first.select("qid", "segment", "window"), ["qid", "segment", "window"], "left_anti").join(bar, "qid", "left")
        return left.filter(F.col("bar").isNull() | (F.col("bound") >= F.col("bar")))

    def windows_scored(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """(windows that top reads through, windows that hold a query's terms), over all queries."""
        blocks, mean, state = self._plan(queries)
        bounds, first = self._bounds(blocks, mean)
        bar = self._bar(self._best(self._scored(blocks, mean, state, first), k), k)
        return first.count() + self._beyond(bounds, first, bar).count(), bounds.count()

    def texts(self, hits: DataFrame) -> DataFrame:
        """hits(ref_id, ord, ...) with the passages' texts."""
        return hits.join(self.live().select("ref_id", "ord", "text"), ["ref_id", "ord"])


def passage_search(index: PassageIndex, queries: DataFrame, n: int = 8, per_ref: int = 2, dense: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """queries(qid, term) -> qid, ref_id, ord, score, place: the n best passages, at most per_ref of a reference.

    Candidates are the max(50, 5 n) best by BM25; dense(qid, ref_id, ord, rank) is another ranking of as many, and the
    two are fused by reciprocal ranks. `within` (ref_id) holds the search to some references.
    """
    most = max(50, 5 * n)
    if within is None:
        ranks = index.top(queries, most).select("qid", "ref_id", "ord", "rank")
    else:  # a filter may leave out most of the best: all its passages are scored
        hits = index.scores(queries).join(within.select("ref_id").distinct(), "ref_id", "left_semi")
        order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "ref_id", "ord")
        ranks = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("qid", "ref_id", "ord", "rank")
    if dense is not None:
        near = dense.filter(F.col("rank") <= most).select("qid", "ref_id", "ord", "rank")
        ranks = ranks.unionByName(near if within is None else near.join(within.select("ref_id").distinct(), "ref_id", "left_semi"))
    fused = ranks.groupBy("qid", "ref_id", "ord").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    best = Window.partitionBy("qid", "ref_id").orderBy(F.desc("score"), "ord")
    capped = fused.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= per_ref).drop("_r")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ref_id", "ord"))
    return capped.withColumn("place", place).filter(F.col("place") <= n)
