"""Interval overlap join of sales and click sessions, on six-hour slots.

Two intervals of a client overlap if one starts within the other. So the join is the union of two disjoint range joins:
sessions that start within a sale, and sales that start strictly within a session. In each, only the interval side is
dealt to buckets of time (all that it touches); the other side is a point and lies in one bucket, so no pair comes twice.

Only slots are compared, hence sales of a client with equal slots behave alike, and so do sessions: both are counted by
(client, start, end) before they meet. A client with a third of all rows has at most as many such classes as time has
slots, however many rows it has; sessions are found among half-hours that hold a click, which is as bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.llm.common import written

HALF_HOUR, SLOT = 1_800_000_000, 21_600_000_000
#: The end of what is open; slots of a bucket on the lowest level, by how much a level's buckets are longer than the one before, levels.
OPEN, WIDTH, GROWTH, LEVELS = 1 << 62, 28, 8, 9


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a column: of timestamps without a zone as they read, whatever the session's zone is."""
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    c = F.col(name)
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def floored(value: Column, unit: int | Column) -> Column:
    """How many whole units a number holds, downwards also below zero."""
    unit = F.lit(unit).cast("long") if isinstance(unit, int) else unit
    return F.call_function("div", value - F.pmod(value, unit), unit)


def sessions(clicks: DataFrame) -> DataFrame:
    """clicks(client_id, ts, kind, ...) -> client_id, first, last (microseconds), open: runs of a client's clicks without a gap of over 30 minutes.

    Clicks without a client or time are left out, repeated ones change nothing; open means that a click at the last
    moment is of kind error. Clicks of one half-hour (by the clock) never are more than 30 minutes apart, so a client's
    half-hours are enough to find the gaps, and its clicks come together in no task.
    """
    c = clicks.select("client_id", micros(clicks, "ts").alias("at"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("error")).filter("client_id IS NOT NULL AND at IS NOT NULL")
    halves = c.groupBy("client_id", floored(F.col("at"), HALF_HOUR).alias("half")).agg(F.min("at").alias("first"), F.max(F.struct("at", "error")).alias("end"))
    by_time = Window.partitionBy("client_id").orderBy("half")
    gap = F.col("first") - F.lag("end.at").over(by_time) > HALF_HOUR
    begins = F.when(F.coalesce(gap, F.lit(True)), F.col("first"))
    runs = halves.withColumn("begin", begins).withColumn("begin", F.last("begin", ignorenulls=True).over(by_time))
    ended = runs.groupBy("client_id", "begin").agg(F.max("end").alias("end"))
    return ended.select("client_id", F.col("begin").alias("first"), F.col("end.at").alias("last"), F.col("end.error").alias("open"))


def spans(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sales, sale_lines -> sale_id, client_id, first, last (microseconds), open: from sold_at to the latest of it and the lines' shipped_at.

    Sales without a client or time are left out; each row of sales is one interval. Lines without a sale_id are nobody's.
    """
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("at")).filter("sale_id IS NOT NULL AND at IS NOT NULL").groupBy("sale_id").agg(F.max("at").alias("shipped"))
    s = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open")).filter("client_id IS NOT NULL AND first IS NOT NULL")
    return s.join(shipped, "sale_id", "left").select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), "open")


def in_slots(df: DataFrame) -> DataFrame:
    """first and last as slots s and e; e of what is open is OPEN."""
    return df.withColumn("s", floored(F.col("first"), SLOT)).withColumn("e", F.when(F.col("open"), F.lit(OPEN)).otherwise(floored(F.col("last"), SLOT)))


def _level(length: Column) -> Column:
    """The lowest level on which an interval of so many slots touches at most GROWTH + 1 buckets."""
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(length <= WIDTH * GROWTH ** (k + 1), F.lit(k)).otherwise(level)
    return level


def _width(level: Column) -> Column:
    width = F.lit(WIDTH * GROWTH ** (LEVELS - 1))
    for k in reversed(range(LEVELS - 1)):
        width = F.when(level == k, F.lit(WIDTH * GROWTH**k)).otherwise(width)
    return width.cast("long")


def starting_within(points: DataFrame, intervals: DataFrame, strictly: bool) -> DataFrame:
    """points(client_id, p_s, ...) joined with the intervals(client_id, i_s, i_e, ...) of the client that hold p_s (strictly: after their start).

    An interval goes to the buckets it touches, on the level where these are few; what reaches beyond the last point ends
    there. A point has one bucket on each level in use. The driver learns the points' last start and the intervals' first.
    """
    last = points.agg(F.max("p_s")).first()[0]
    first = intervals.agg(F.min("i_s")).first()[0]
    if last is None or first is None:
        return points.join(intervals, "client_id").limit(0)
    highest = next((k for k in range(LEVELS) if last - first < WIDTH * GROWTH ** (k + 1)), LEVELS - 1)
    end = F.least(F.col("i_e"), F.lit(last))
    dealt = intervals.filter(F.col("i_s") <= last).withColumn("level", _level(end - F.col("i_s") + 1))
    width = _width(F.col("level"))
    dealt = dealt.withColumn("bucket", F.explode(F.sequence(floored(F.col("i_s"), width), floored(end, width))))
    point = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(highest))))
    point = point.withColumn("bucket", floored(F.col("p_s"), _width(F.col("level"))))
    after = F.col("p_s") > F.col("i_s") if strictly else F.col("p_s") >= F.col("i_s")
    return point.join(dealt, ["client_id", "level", "bucket"]).filter(after & (F.col("p_s") <= F.col("i_e"))).drop("level", "bucket")


#: What a sale is to a session, by which of the two starts first and which ends first (the sale; both; the session).
RELATIONS = (("overlaps", "finished_by", "contains"), ("starts", "equals", "started_by"), ("during", "finishes", "overlapped_by"))


def _relation() -> Column:
    by_end = lambda names: F.when(F.col("a_e") < F.col("b_e"), names[0]).when(F.col("a_e") == F.col("b_e"), names[1]).otherwise(names[2])
    return F.when(F.col("a_s") < F.col("b_s"), by_end(RELATIONS[0])).when(F.col("a_s") == F.col("b_s"), by_end(RELATIONS[1])).otherwise(by_end(RELATIONS[2]))


def related(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(client_id, a_s, a_e), b(client_id, b_s, b_e, n, crc): each a's relations to the b that share a slot, with the number of b, the slots shared and the sum of crc."""
    to = lambda df, side, like: df.withColumnsRenamed({f"{side}_s": f"{like}_s", f"{side}_e": f"{like}_e"})
    back = lambda df, points, intervals: df.withColumnsRenamed({"p_s": f"{points}_s", "p_e": f"{points}_e", "i_s": f"{intervals}_s", "i_e": f"{intervals}_e"})
    b_starts = back(starting_within(to(b, "b", "p"), to(a, "a", "i"), False), "b", "a")
    a_starts = back(starting_within(to(a, "a", "p"), to(b, "b", "i"), True), "a", "b")
    shared = F.least("a_e", "b_e") - F.greatest("a_s", "b_s") + 1
    pairs = b_starts.unionByName(a_starts).withColumn("relation", _relation()).withColumn("shared", F.when(F.least("a_e", "b_e") < OPEN, shared * F.col("n")))
    return pairs.groupBy("client_id", "a_s", "a_e", "relation").agg(F.sum("n").alias("n_pairs"), F.sum("shared").alias("overlap_slots"), F.sum("crc").alias("sessions_crc"))


def sales_and_sessions(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots, sessions_crc: each sale's relations to the sessions of its client that share a slot with it.

    Sales without such a session have no row. Sales that repeat a sale_id (or lack one) are intervals of their own whose
    figures are added up. Empty tables give an empty result; other columns are ignored.
    """
    sold = written(in_slots(spans(sales, lines)).select("sale_id", "client_id", F.col("s").alias("a_s"), F.col("e").alias("a_e")), "sales")
    seen = in_slots(sessions(clicks)).withColumn("crc", F.crc32(F.col("first").cast("string").cast("binary")))
    seen = seen.groupBy("client_id", F.col("s").alias("b_s"), F.col("e").alias("b_e")).agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    classes = sold.select("client_id", "a_s", "a_e").distinct()
    found = related(written(classes, "sale-classes"), written(seen, "session-classes"))
    each = sold.join(found, ["client_id", "a_s", "a_e"])
    return each.groupBy("sale_id", "relation").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("overlap_slots").alias("overlap_slots"), F.sum("sessions_crc").alias("sessions_crc"))


#: Sessions by windows over single clicks, a plain join by client, CRC-32 from its definition.
ORACLE_SQL = r"""
WITH c AS (SELECT client_id, epoch_us(ts) AS t, coalesce(kind = 'error', false) AS err FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY client_id ORDER BY t)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS run FROM g),
x AS (SELECT client_id, run, min(t) AS f, max(t) AS l, max(struct_pack(t := t, e := err)).e AS is_open FROM r GROUP BY 1, 2),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_of),
b AS (SELECT client_id, f // 21600000000 - (f % 21600000000 < 0)::BIGINT AS s, CASE WHEN is_open THEN 'Infinity'::DOUBLE ELSE l // 21600000000 - (l % 21600000000 < 0)::BIGINT END AS e,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(f::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, d: xor(a >> 8, crc_of[(xor(a, d) & 255) + 1])), 4294967295) AS crc FROM x, tab),
m AS (SELECT sale_id, max(epoch_us(shipped_at)) AS shipped FROM sale_lines GROUP BY 1),
s AS (SELECT sale_id, client_id, epoch_us(sold_at) AS f, greatest(epoch_us(sold_at), coalesce(shipped, epoch_us(sold_at))) AS l, coalesce(status = 'open', false) AS is_open
    FROM sales LEFT JOIN m USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
a AS (SELECT sale_id, client_id, f // 21600000000 - (f % 21600000000 < 0)::BIGINT AS s, CASE WHEN is_open THEN 'Infinity'::DOUBLE ELSE l // 21600000000 - (l % 21600000000 < 0)::BIGINT END AS e FROM s),
p AS (SELECT sale_id, crc, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS shared,
    ['overlaps', 'finished_by', 'contains', 'starts', 'equals', 'started_by', 'during', 'finishes', 'overlapped_by'][(CASE WHEN a.s < b.s THEN 0 WHEN a.s = b.s THEN 3 ELSE 6 END + CASE WHEN a.e < b.e THEN 1 WHEN a.e = b.e THEN 2 ELSE 3 END)::INT] AS relation
    FROM a JOIN b ON a.client_id = b.client_id AND a.s <= b.e AND b.s <= a.e)
SELECT sale_id, relation, count(*) AS n_pairs, sum(CASE WHEN shared < 'Infinity'::DOUBLE THEN shared END)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc FROM p GROUP BY 1, 2
"""
