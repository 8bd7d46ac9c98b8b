"""Relational core: scans, lookups, keyed merges, bridges, divisions, sparse updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.sources.tables import settled


def scan(refs: DataFrame, year_from=None, year_to=None, ref_type=None, open_access_only=False) -> DataFrame:
    """The filters of every listing, each only if given; they reach the Parquet scan."""
    for cond in (
        F.col("year") >= year_from if year_from is not None else None, F.col("year") <= year_to if year_to is not None else None,
        F.col("ref_type") == ref_type if ref_type else None, F.col("open_access") if open_access_only else None,
    ):
        if cond is not None:
            refs = refs.filter(cond)
    return refs


def keyset_page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next n rows by key after a cursor (None: from the start)."""
    return (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(n)


def in_given_order(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """The rows of the given keys, in their order, missing ones left out. The list is the caller's, so it is small."""
    wanted = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(ids)], f"pos int, {key} {dict(df.dtypes)[key]}")
    return df.join(F.broadcast(wanted), key).orderBy("pos").drop("pos")


def within_collection(refs: DataFrame, bridge: DataFrame, collection, text: str, key: str = "id") -> DataFrame:
    """The records of one collection whose title or authors' family names hold the text, case ignored (empty text: all)."""
    members = bridge.filter(F.col("collection_id") == F.lit(collection)).select(F.col("ref_id").alias(key))
    low = F.lit(text.lower())
    families = F.array_join(F.transform("authors", lambda a: F.coalesce(a["family"], F.lit(""))), " ")
    hit = F.contains(F.lower(F.coalesce("title", F.lit(""))), low) | F.contains(F.lower(F.coalesce(families, F.lit(""))), low)
    return refs.filter(hit).join(members, key, "left_semi")


def shuffled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in an order that looks random: by a seeded hash of the key, so reruns and other partitionings agree."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def newest(df: DataFrame, sequence: str, n: int, most: int = 1000) -> DataFrame:
    """The n most recently ingested rows, at most 1000."""
    return df.orderBy(F.desc(sequence)).limit(min(n, most))


def having_all(items: DataFrame, bridge: DataFrame, key: str, label: str, labels: Sequence) -> DataFrame:
    """Relational division: the items that the bridge links with every one of the labels."""
    want = list(dict.fromkeys(labels))
    whole = bridge.filter(F.col(label).isin(want)).groupBy(key).agg(F.countDistinct(label).alias("n")).filter(F.col("n") == len(want))
    return items.join(whole.select(key), key, "left_semi")


def with_counts(dimension: DataFrame, bridge: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Every row of a dimension with its number of bridge rows, zero too; the bridge is counted before the join."""
    counts = bridge.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return dimension.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def labels_of(bridge: DataFrame, key: str, label: str) -> DataFrame:
    """key -> its sorted labels as an array."""
    return bridge.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def absent_or_newer(rows: DataFrame, ledger: DataFrame, key: str, updated: str, tried: str) -> DataFrame:
    """Rows without a ledger entry, or changed since it."""
    last = ledger.groupBy(key).agg(F.max(tried).alias("_tried"))
    return rows.join(last, key, "left").filter(F.col("_tried").isNull() | (F.col(updated) > F.col("_tried"))).drop("_tried")


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key: the first by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(base: DataFrame, batch: DataFrame, key: str = "id", unique: str | None = "doi", keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """The next version of base: batch rows replace rows of the same key.

    batch has the columns of base and `batch_seq`; of rows with one key the last wins. A batch row whose `unique` value
    belongs to another base row takes that row's key. The columns in `keep` stay as they were. Two shuffles by key.
    """
    if unique:
        owner = base.filter(F.col(unique).isNotNull()).select(F.col(unique), F.col(key).alias("_owner"))
        batch = batch.join(owner, unique, "left").withColumn(key, F.coalesce("_owner", key)).drop("_owner")
        first = Window.partitionBy(F.coalesce(F.col(unique), F.concat(F.lit("\0"), F.col(key)))).orderBy("batch_seq")
        batch = batch.withColumn(key, F.first(key).over(first))
    batch = latest(batch, [key], F.desc("batch_seq")).drop("batch_seq")
    old = base.select(key, *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_known"))
    fresh = batch.join(old, key, "left")
    for c in keep:
        fresh = fresh.withColumn(c, F.coalesce(f"_old_{c}", c))
    return base.join(batch.select(key), key, "left_anti").unionByName(fresh.select(base.columns))


def sparse_update(base: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Null in the patch leaves a column as it is."""
    columns = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(renamed, key, "left")
    return joined.select([F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def set_integration_ids(base: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Ids that other services gave (and where files lie), null leaving a column as it is; the patch's `extras` (a JSON object) are added to the stored ones."""
    if "extras" not in patch.columns:
        return sparse_update(base, patch, key)
    new, kind = "_more", "map<string,string>"
    joined = sparse_update(base, patch.drop("extras"), key).join(patch.select(key, F.from_json("extras", kind).alias(new)), key, "left")
    empty = F.create_map().cast(kind)
    old, more = F.coalesce(F.from_json("extras", kind), empty), F.coalesce(new, empty)
    both = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(more, k)), more)
    return joined.withColumn("extras", F.when(F.col(new).isNull(), F.col("extras")).otherwise(F.to_json(both))).select(base.columns)


def replace_unless_taken(base: DataFrame, changes: DataFrame, key: str = "id", unique: str = "doi") -> tuple[DataFrame, DataFrame]:
    """(changes with `unique` nulled where another row owns it, collisions(key, other, value))."""
    owner = base.filter(F.col(unique).isNotNull()).select(F.col(unique), F.col(key).alias("_owner"))
    joined = changes.join(owner, unique, "left")
    taken = F.col("_owner").isNotNull() & (F.col("_owner") != F.col(key))
    collisions = joined.filter(taken).select(F.col(key), F.col("_owner").alias("other"), F.col(unique).alias("value"))
    return joined.withColumn(unique, F.when(~taken, F.col(unique))).select(changes.columns), collisions


def delete(base: DataFrame, ids: DataFrame, key: str = "id", bridges: Sequence[tuple[DataFrame, str]] = ()) -> list[DataFrame]:
    """base and its bridges without the given keys (a cascade)."""
    return [base.join(ids.select(key), key, "left_anti")] + [b.join(ids.select(F.col(key).alias(k)), k, "left_anti") for b, k in bridges]


def archive(live: DataFrame, archived: DataFrame, ids: DataFrame, rule: str, as_of, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Move rows to the archive with a reason; the archive gains columns the live table has gained."""
    gone = live.join(ids.select(key).distinct(), key, "left_semi").withColumns({"archive_rule": F.lit(rule), "archived_at": F.lit(as_of)})
    return live.join(ids.select(key), key, "left_anti"), archived.unionByName(gone, allowMissingColumns=True)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union on a key: rows whose key exists are dropped."""
    return table.unionByName(rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def rename_label(dimension: DataFrame, old: str, new: str, name: str = "name") -> DataFrame:
    """Rename unless the new name exists; then nothing changes."""
    taken = dimension.filter(F.col(name) == new).limit(1).select(F.lit(1).alias("_taken"))
    joined = dimension.join(F.broadcast(taken), F.lit(True), "left")
    return joined.withColumn(name, F.when((F.col(name) == old) & F.col("_taken").isNull(), F.lit(new)).otherwise(F.col(name))).drop("_taken")


def cascade_lookup(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, Column, Column]], right_id: str = "id", last: bool = False) -> DataFrame:
    """left with `match_id` and `match_by`: the first of the keys (name, left key, right key) that finds a row.

    Each key map holds one row a key (the smallest id, or the largest with `last`), so no join multiplies rows.
    """
    pick = F.max if last else F.min
    names = []
    for i, (name, lk, rk) in enumerate(keys):
        index = right.select(rk.alias(f"_k{i}"), F.col(right_id).alias("_id")).filter(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(pick("_id").alias(f"_m{i}"))
        left = left.withColumn(f"_k{i}", lk).join(index, f"_k{i}", "left").drop(f"_k{i}")
        names.append((name, f"_m{i}"))
    by = F.coalesce(*[F.when(F.col(m).isNotNull(), F.lit(n)) for n, m in names])
    return left.withColumns({"match_id": F.coalesce(*[m for _, m in names]), "match_by": by}).drop(*[m for _, m in names])


def new_or_changed(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files that the log does not hold with the same size and time."""
    return files.join(log.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def repair_paths(refs: DataFrame, files: DataFrame, path: str = "pdf_path") -> DataFrame:
    """refs with `outcome` kept / moved / stale and the path to use: the listed path, else one of the same base name."""
    base = lambda c: F.lower(F.substring_index(c, "/", -1))
    exact = files.select(F.col("path").alias("_exact")).distinct()
    by_name = files.groupBy(base(F.col("path")).alias("_name")).agg(F.min("path").alias("_found"))
    x = refs.filter(F.col(path).isNotNull()).withColumn("_name", base(F.col(path)))
    x = x.join(exact, F.col(path) == F.col("_exact"), "left").join(by_name, "_name", "left")
    outcome = F.when(F.col("_exact").isNotNull(), "kept").when(F.col("_found").isNotNull(), "moved").otherwise("stale")
    return x.withColumns({"outcome": outcome, "new_path": F.coalesce("_exact", "_found")}).drop("_exact", "_name", "_found")


def chunked(df: DataFrame, order: Sequence[str], size: int = 100) -> DataFrame:
    """df with `chunk`: consecutive groups of so many rows by the order, numbered without a global sort into one task.

    Rows are range-partitioned and written before anything is counted, with the number of their part: a part's rows and
    its place must not come from two evaluations. Counts of the parts (one row each) give every part its offset.
    """
    parts = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each part
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_at", at).join(F.broadcast(before), "_p").withColumn("chunk", F.floor((F.col("_before") + F.col("_at")) / size)).drop("_p", "_at", "_before")


def ranked(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df with `rank`, its place from 1 in the whole order (which must be total), without a sort in one task."""
    return chunked(df, order, 1).withColumn("rank", F.col("chunk") + 1).drop("chunk")
