"""Entity resolution over records: keys, vetoes, survivors, fuzzy titles, applying pairs to all tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.sources.tables import settled
from codexlake.functions import text as T
from codexlake.functions.model import filled
from codexlake.functions.scalar import PLACEHOLDER_TITLES, quality_score
from codexlake.operators.windows import survivors

#: The characters of a normalised title.
_TITLE = np.frombuffer(b" 0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)


def _key(name: str) -> Column:
    return F.when(filled(F.trim(name)), F.lower(F.trim(name)))


def identifier_pairs(refs: DataFrame, identifier: str, sides=()) -> DataFrame:
    return survivors(refs, [_key(identifier)], quality_score(), sides=sides)


def url_title_year_pairs(refs: DataFrame, sides=()) -> DataFrame:
    """Same address, title and year, placeholders left out."""
    title = F.lower(F.trim("title"))
    usable = refs.filter(~title.isin(*PLACEHOLDER_TITLES) & ~F.col("title").ilike("%just a moment%") & ~F.col("title").ilike("%download limit exceeded%"))
    return survivors(usable, [_key("url"), F.when(title != "", title), F.col("year")], quality_score(), sides=sides)


def url_pairs(refs: DataFrame, sides=()) -> DataFrame:
    """Same address of 16 characters and more."""
    return survivors(refs.filter((F.length(F.trim("url")) >= 16) & ~F.col("url").rlike(r"^https?://[^/]+/?$")), [_key("url")], quality_score(), sides=sides)


def title_year_author_pairs(refs: DataFrame, sides=()) -> DataFrame:
    return survivors(refs, [_key("title"), F.col("year"), F.lower(F.try_element_at("authors", F.lit(1))["family"])], quality_score(), sides=sides)


def type_family(c: Column) -> Column:
    return F.when(F.lower(c).isin("book", "monograph", "edited-book", "reference-book"), "book").when(F.lower(c).isin("book-chapter", "chapter", "book-section", "reference-entry"), "chapter").otherwise("other")


def both_sides(pairs: DataFrame, refs: DataFrame, *columns: str) -> DataFrame:
    """pairs with columns of both records, as k_ and d_; those that the pairs bring along are not looked up again."""
    for side, key in (("k", "keep_id"), ("d", "drop_id")):
        lacking = [c for c in columns if f"{side}_{c}" not in pairs.columns]
        if lacking:
            pairs = pairs.join(refs.select(F.col("id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in lacking]).hint("merge"), key)
    return pairs


def veto_titles(pairs: DataFrame, refs: DataFrame, strict: bool) -> DataFrame:
    """Pairs whose titles agree. Strict: near-identical and of one kind of item; else shared words must dominate."""
    x = both_sides(pairs, refs, "title", "ref_type")
    if strict:
        ok = T.udf_titles_same()("k_title", "d_title") & (type_family(F.col("k_ref_type")) == type_family(F.col("d_ref_type")))
    else:
        ok = T.udf_titles_compatible()("k_title", "d_title")
    return x.filter(ok).select(pairs.columns)


STRONG = ("doi", "pmid", "pmcid", "arxiv_id", "isbn")


def veto_conflicts(pairs: DataFrame, refs: DataFrame, besides: str | None = None) -> DataFrame:
    """Pairs without two different values of a strong identifier."""
    strong = [c for c in STRONG if c != besides]
    x = both_sides(pairs, refs, *strong)
    bad = F.lit(False)
    for c in strong:
        bad = bad | F.coalesce(filled(f"k_{c}") & filled(f"d_{c}") & (F.lower(f"k_{c}") != F.lower(f"d_{c}")), F.lit(False))
    return x.filter(~bad).select(pairs.columns)


def collision_merges(collisions: DataFrame, refs: DataFrame) -> DataFrame:
    """collisions(id, other) that may merge: titles agree strictly, years within three, no chains (a row in two pairs goes by the smallest pair)."""
    pairs = collisions.select(F.col("other").alias("keep_id"), F.col("id").alias("drop_id")).distinct()
    x = both_sides(pairs, refs, "title", "year").filter(F.col("k_year").isNull() | F.col("d_year").isNull() | (F.abs(F.col("k_year") - F.col("d_year")) <= 3))
    x = x.filter(T.udf_titles_agree()("k_title", "d_title")).select("keep_id", "drop_id")
    x = x.filter("keep_id <> drop_id")
    once = x.groupBy("drop_id").agg(F.min("keep_id").alias("keep_id"))
    return once.join(once.select(F.col("drop_id").alias("keep_id")), "keep_id", "left_anti")


def _donors(pairs: DataFrame, refs: DataFrame) -> DataFrame:
    """The merged-away rows with their keep_id and _ord, their order by quality, then id."""
    return pairs.join(refs.withColumn("_ord", F.struct(-quality_score(), F.col("id"))).withColumnRenamed("id", "drop_id").hint("merge"), "drop_id")


def _best_filled(column: str) -> Column:
    return F.min_by(column, F.when(filled(F.col(column).cast("string")), F.col("_ord")))


def fill_plan(pairs: DataFrame, refs: DataFrame, columns) -> DataFrame:
    """keep_id and, for each column, the value of the best merged-away row that has one (best quality, then id)."""
    return _donors(pairs, refs).groupBy("keep_id").agg(*[_best_filled(c).alias(c) for c in columns])


def apply_pairs(refs: DataFrame, pairs: DataFrame, fill, bridges: dict[str, tuple[DataFrame, str]] | None = None, rule: str = "duplicate"):
    """(live, archived, bridges): keepers filled from their twins and rolled up, twins archived, bridges re-pointed.

    Scalars are filled only where empty; citation counts and completeness take the maximum, open access any, created_at
    the earliest. Everything is keyed by keep_id: as many shuffles as tables, none by content. Pairs are two identifiers a
    row, so a task keeps its share of them and records pass by unsorted; no table goes whole to every task.
    """
    rolled = [F.max("citation_count").alias("_cc"), F.max("completeness").alias("_co"), F.bool_or("open_access").alias("_oa"), F.min("created_at").alias("_cr")]
    plan = _donors(pairs, refs).groupBy(F.col("keep_id").alias("id")).agg(*[_best_filled(c).alias(f"_f_{c}") for c in fill], *rolled)
    live = refs.join(pairs.select(F.col("drop_id").alias("id")).hint("shuffle_hash"), "id", "left_anti").join(plan.hint("merge"), "id", "left")
    for c in fill:
        live = live.withColumn(c, F.when(filled(F.col(c).cast("string")), F.col(c)).otherwise(F.col(f"_f_{c}")))
    live = live.withColumns({
        "citation_count": F.greatest("citation_count", "_cc"), "completeness": F.greatest("completeness", "_co"),
        "open_access": F.when(F.coalesce("open_access", F.lit(False)) | F.coalesce("_oa", F.lit(False)), True).otherwise(F.coalesce("open_access", "_oa")), "created_at": F.least("created_at", "_cr"),
    }).select(refs.columns)
    archived = refs.join(pairs.select(F.col("drop_id").alias("id"), F.col("keep_id").alias("merged_into")).hint("shuffle_hash"), "id").withColumn("archive_rule", F.lit(rule))
    moved = {}
    for name, (bridge, key) in (bridges or {}).items():
        to = pairs.select(F.col("drop_id").alias(key), F.col("keep_id").alias("_to"))
        moved[name] = bridge.join(to.hint("shuffle_hash"), key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to").dropDuplicates()
    return live, archived, moved


def dedup_all(refs: DataFrame, fill, everything: bool = False):
    """All rules one after the other, each on what the one before left: (live, archived).

    Pairs and each rule's result are checkpointed, so the plan stays short; a rule without pairs rewrites nothing. What
    the vetoes look at comes along with the pairs.
    """
    archived = None
    looked = lambda i=None: ("title", "ref_type", *[c for c in STRONG if c != i])
    rules = [(i, lambda r, i=i: veto_conflicts(veto_titles(identifier_pairs(r, i, looked(i)), r, strict=i == "isbn"), r, i)) for i in STRONG]
    rules.append(("url_title_year", lambda r: veto_conflicts(url_title_year_pairs(r, STRONG), r)))
    if everything:
        rules.append(("url", lambda r: veto_conflicts(veto_titles(url_pairs(r, looked()), r, strict=True), r)))
        rules.append(("title_year_author", lambda r: veto_conflicts(title_year_author_pairs(r, STRONG), r)))
    for name, rule in rules:
        pairs = settled(rule(refs).select("keep_id", "drop_id"))
        if pairs.isEmpty():
            continue
        live, gone, _ = apply_pairs(refs, pairs, fill, rule=f"same_{name}")
        refs, gone = settled(live), settled(gone)
        archived = gone if archived is None else archived.unionByName(gone)
    if archived is None:
        archived = refs.limit(0).withColumns({"merged_into": F.lit(""), "archive_rule": F.lit("")})
    return refs, archived


def _near_titles(least: float):
    """The cells of one task: (a, b, id_a, id_b, score) of their pairs of sorted words that reach the ratio.

    A cell's titles are in order of length, so the lengths that can reach the ratio are a stretch of them; the characters
    two titles do not share bound the ratio from above. What is left is compared in batches of similar length.
    """
    far = (100 - least) / 100

    def pairs_of(rows, size, counts, high, chunk, across):
        upto = np.searchsorted(size[rows], size[rows] * (1 + far) / (1 - far) + 1e-6, "right")
        for x, at in enumerate(rows):
            y = rows[x + 1 : upto[x]]
            y = y[~(high[y] & high[at]) & (size[y] - size[at] <= 0.4 * size[y])]
            if across:
                y = y[chunk[y] != chunk[at]]
            y = y[np.abs(counts[y] - counts[at]).sum(axis=1) <= far * (size[y] + size[at]) + 1e-6]
            yield np.stack([np.full(len(y), at), y], axis=1)

    def run(cells: pa.Table) -> pa.Table:
        words, ids, high, chunk = cells["s"].to_pylist(), cells["id"], cells["high"].to_numpy(), cells["chunk"].to_numpy()
        size = np.array([len(t) for t in words])
        counts = np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=128)[_TITLE] for t in words], dtype=np.int32)
        names = list(zip(*(cells[c].to_pylist() for c in ("block", "class", "i", "j"))))
        held: dict[tuple, list[int]] = {}
        for at in np.argsort(size, kind="stable").tolist():
            held.setdefault(names[at], []).append(at)
        found, left, n = [], [], 0
        for (_, _, i, j), rows in held.items():
            for some in pairs_of(np.array(rows), size, counts, high, chunk, i != j):
                left.append(some)
                n += len(some)
                if n >= 1 << 18:
                    found.append(T.indel_ratios(words, np.concatenate(left), least))
                    left, n = [], 0
        found.append(T.indel_ratios(words, np.concatenate([np.empty((0, 2), np.int64), *left]), least))
        x, y, score = (np.concatenate([f[k] for f in found]) for k in range(3))
        return pa.table({"block": cells["block"].take(pa.array(x)), "a": cells["s"].take(pa.array(x)), "b": cells["s"].take(pa.array(y)), "id_a": ids.take(pa.array(x)), "id_b": ids.take(pa.array(y)), "score": score})

    return run


def _titles(refs: DataFrame, id_col: str, title: str, shortest: int) -> DataFrame:
    """id, block (the first word, 3 letters and more) and s (the words in order) of titles of so many characters."""
    # not deterministic for the optimiser: it would run the function once more for each filter on what it gives
    t = T.udf_ascii_title().asNondeterministic()(F.col(title))
    w = refs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), t.alias("t")).withColumn("block", F.split_part("t", F.lit(" "), F.lit(1)))
    w = w.filter((F.length("block") >= 3) & (F.length("t") >= shortest))
    return w.select("id", "block", F.array_join(F.array_sort(F.split("t", " ")), " ").alias("s"))


def _title_classes(titles: DataFrame) -> DataFrame:
    """block, s, id, n: titles of one first word and the same words, their smallest id and their number."""
    return settled(titles.groupBy("block", "s").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))


def _near_classes(classes: DataFrame, least: float, largest: int) -> DataFrame:
    """block, a, b, id_a, id_b, score: pairs of different classes of one block, by their sorted words."""
    step = -math.log(max(0.6, least / (200 - least))) + 1e-6
    w = classes.select("block", "s", "id").withColumn("class", F.floor(F.log(F.length("s")) / step))
    w = w.select("id", "s", "block", F.explode(F.array(F.struct("class", F.lit(False).alias("high")), F.struct((F.col("class") - 1).alias("class"), F.lit(True).alias("high")))).alias("c")).select("id", "s", "block", "c.*")
    size = w.groupBy("block", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("high")).alias("low"), F.sum(F.length("s")).alias("chars")).filter("n > 1 AND low > 0")
    size = settled(size.select("block", "class", "n", F.greatest(F.ceil(F.col("n") / largest), F.ceil(F.col("chars") / 2**23)).cast("int").alias("chunks")))
    rows, cells = size.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("chunks") > 1, F.col("chunks") * (F.col("chunks") + 1) / 2)), F.lit(0)).cast("long")).first()
    small = rows // largest + 1
    w = w.join(size, ["block", "class"]).withColumn("chunk", F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int"))
    w = w.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    w = w.select("id", "s", "high", "chunk", "block", "class", "chunks", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    # small blocks share a group, about `largest` rows in each; two chunks of a large one have their own
    group = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("block", "class"), F.lit(small))).otherwise(F.xxhash64("block", "class", "i", "j"))
    kind = w.schema["id"].dataType.simpleString()
    # as many tasks as groups: the work is in the pairs, of which the bytes of the titles say nothing
    return w.withColumn("group", group).repartition(min(small + cells, 2000), "group").groupBy("group").applyInArrow(_near_titles(least), f"block string, a string, b string, id_a {kind}, id_b {kind}, score double")


def _labelled(pairs: DataFrame, likely: float, *more: str) -> DataFrame:
    return pairs.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "score", F.when(F.col("score") >= likely, "likely").otherwise("possible").alias("label"), *more)


def fuzzy_title_classes(refs: DataFrame, id_col: str = "id", title: str = "title", least: float = 90, likely: float = 95, largest: int = 2000, shortest: int = 0) -> DataFrame:
    """(id_a, id_b, score, label, same_words): what fuzzy_title_pairs finds, with one row a title instead of all pairs of copies.

    Titles of one first word and the same words are a class, named by its smallest id. Rows with same_words say that id_b
    is of the class of id_a; the others are pairs of classes, and their score is that of any two of their members.
    """
    titles = _titles(refs, id_col, title, shortest)
    classes = _title_classes(titles)
    key = F.md5(F.concat_ws("|", "block", "s"))
    members = titles.select(F.col("id").alias("id_b"), key.alias("k")).join(classes.filter("n > 1").select(F.col("id").alias("id_a"), key.alias("k")), "k")
    same = members.select("id_a", "id_b", F.lit(100.0).alias("score"), F.lit(True).alias("same_words"))
    near = _near_classes(classes, least, largest).select("id_a", "id_b", "score", F.lit(False).alias("same_words"))
    return _labelled(same.unionByName(near), likely, "same_words")


def fuzzy_title_pairs(refs: DataFrame, id_col: str = "id", title: str = "title", least: float = 90, likely: float = 95, largest: int = 2000, shortest: int = 0) -> DataFrame:
    """(id_a, id_b, score, label): all pairs of titles of one first word (3 letters and more) and similar length, token-sort ratio.

    Blocks of any size are compared. Lengths that can reach the ratio are in one or in neighbouring classes; the titles
    of a class and the next are dealt into chunks of about `largest` rows, and every two chunks meet in one task. Titles
    of the same words are compared once; their pairs are as many as the square of the copies (see fuzzy_title_classes).
    """
    titles = _titles(refs, id_col, title, shortest)
    near = _near_classes(_title_classes(titles), least, largest)
    side = lambda name, words: titles.select("block", F.col("s").alias(words), F.col("id").alias(name))
    pairs = near.select("block", "a", "b", "score").join(side("id_a", "a"), ["block", "a"]).join(side("id_b", "b"), ["block", "b"])
    same = side("id_a", "a").join(side("id_b", "a"), ["block", "a"]).filter("id_a < id_b").withColumn("score", F.lit(100.0))
    return _labelled(pairs.select("id_a", "id_b", "score").unionByName(same.select("id_a", "id_b", "score")), likely)


def duplicate_report(refs: DataFrame) -> DataFrame:
    """(label, rule, key, n): groups by identifiers (certain), address and title with year (likely), title (possible)."""
    rules = [("certain", i, _key(i)) for i in ("doi", "pmid", "arxiv_id", "isbn")]
    rules += [("likely", "url", _key("url")), ("likely", "title_year", F.when(filled("title") & F.col("year").isNotNull(), F.concat(_key("title"), F.lit("|"), F.col("year").cast("string")))), ("possible", "title", _key("title"))]
    every = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("rule"), k.alias("key")) for a, b, k in rules]))
    g = refs.select(every.alias("r")).select("r.*").filter("key IS NOT NULL").groupBy("label", "rule", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.orderBy(F.when(F.col("label") == "certain", 0).when(F.col("label") == "likely", 1).otherwise(2), F.desc("n"), "rule", "key")


