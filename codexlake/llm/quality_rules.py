r"""Quality rules: base rules, then robust multivariate outliers by the minimum covariance determinant. SQL only.

Each text becomes a few counts and from them a vector of four statistics: the logarithms of word length, punctuation,
words a line and capitals. All vary in clean text, so their covariance says what is usual. Counts are first mixed with
those of PRIOR usual words, so short texts do not stand out for their length alone. Vectors are held in 1/1024 steps, so
sums of their products are whole numbers and come out the same in any order; equal vectors of a group count once, so
copies do not make an estimate collapse. Per language and source, concentration steps from two starts (scaled and plain
distances from the median) look for the subset of least covariance determinant; distances are made consistent by their
median, and what lies beyond a chi-square quantile is rejected. State is one row per group and start; documents are
only joined with it, never gathered: medians and cut points are exact percentiles over a bounded number of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import WORD_GAP, discard, written
from codexlake.llm.mixing import GAPS

#: Documents of a group, at least; smaller ones are pooled by language, then altogether.
LEAST = 60
#: Share of a group in the subset of least determinant, and concentration steps.
SUBSET, STEPS = 0.75, 6
#: Usual words that a text's counts are mixed with.
PRIOR = 200
#: Chi-square quantiles of four degrees of freedom: the median, and 1 - 1e-5, beyond which a document is rejected.
MEDIAN, CUTOFF = 3.357, 28.47
#: Standard deviation added to each statistic, so that a group without any variance still has distances.
RIDGE = 0.03

_VECTOR = (
    f"ln((word_chars + {5 * PRIOR}.0) / (n_words + {PRIOR}.0))",
    f"ln((n_punct + 4.0 * n_symbols + {0.14 * PRIOR}) / (word_chars + {5 * PRIOR}.0))",
    f"ln((n_words + {PRIOR}.0) / (n_lines + {PRIOR / 40}))",
    f"ln((n_upper + {0.085 * PRIOR}) / (word_chars + {5 * PRIOR}.0))",
)
P = len(_VECTOR)
#: Punctuation of ASCII.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def base_counts(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_punct, n_upper of whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(GAPS))
    without = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    a = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)).alias("words"),
        F.length(F.translate(text, GAPS, "")).cast("long").alias("word_chars"), without("#*$%&|<>").alias("n_symbols"), without(PUNCTUATION).alias("n_punct"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(GAPS)) != "").alias("lines"),
    )
    b = a.select("doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_punct", "n_upper", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    at = [f"wh[i + {k}]" for k in range(5)]
    c = b.withColumn("win", F.expr(f"if(n_words >= 5, transform(sequence(0, cast(n_words as int) - 5), i -> xxhash64({', '.join(at)})), cast(array() as array<bigint>))")).drop("wh")
    d = c.withColumn("srt", F.expr("if(size(array_distinct(win)) = size(win), null, sort_array(transform(win, (h, i) -> struct(h, i))))")).drop("win")
    e = d.withColumn("pos", F.expr("array_sort(transform(filter(srt, (x, k) -> coalesce(x.h = get(srt, k - 1).h, false) or coalesce(x.h = get(srt, k + 1).h, false)), x -> x.i))")).drop("srt")
    return e.withColumn("n_repeat_words", F.expr("coalesce(aggregate(transform(pos, (p, k) -> if(k = 0, 5, least(5, p - get(pos, k - 1)))), 0, (s, x) -> s + x), 0)").cast("long")).drop("pos")


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _pairs():
    return [(i, j) for i in range(P) for j in range(i + 1)]


def counts_sql(base: str) -> str:
    """Rows of each language and source (n3), and of a language's small sources together (n2)."""
    return f"""
        SELECT glang, gsource, n3, CAST(sum(CASE WHEN n3 < {LEAST} THEN n3 ELSE 0 END) OVER (PARTITION BY glang) AS BIGINT) AS n2
        FROM (SELECT coalesce('=' || lang, '-') AS glang, coalesce('=' || source, '-') AS gsource, count(*) AS n3 FROM {base} WHERE NOT base_failed GROUP BY 1, 2) x"""


def vectors_sql(base: str, counts: str) -> str:
    """All documents; those that pass the base rules with quantised vectors and the names of their groups."""
    q = ", ".join(f"CASE WHEN NOT base_failed THEN CAST(floor(1024 * {e} + 0.5) AS BIGINT) END AS q{i}" for i, e in enumerate(_VECTOR))
    return f"""
        SELECT v.*, {q},
               CASE WHEN base_failed THEN NULL WHEN c.n3 >= {LEAST} OR c.n2 >= {LEAST} THEN v.glang ELSE '*' END AS g1,
               CASE WHEN base_failed THEN NULL WHEN c.n3 >= {LEAST} THEN v.gsource ELSE '*' END AS g2
        FROM (SELECT *, coalesce('=' || lang, '-') AS glang, coalesce('=' || source, '-') AS gsource FROM {base}) v
        LEFT JOIN {counts} c ON v.glang = c.glang AND v.gsource = c.gsource"""


def distinct_sql(vectors: str) -> str:
    """The different vectors of each group."""
    return f"SELECT DISTINCT g1, g2, {', '.join(f'q{i}' for i in range(P))} FROM {vectors} v WHERE NOT base_failed"


def medians_sql(vectors: str) -> str:
    med = ", ".join(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY q{i}) AS m{i}" for i in range(P))
    return f"SELECT g1, g2, {med} FROM {vectors} v GROUP BY g1, g2"


def start_sql(vectors: str, medians: str) -> str:
    """Medians of each group, twice: with a scale from the median deviation, and with a common one."""
    mad = ", ".join(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(v.q{i} - m.m{i})) AS s{i}" for i in range(P))
    means = ", ".join(f"CAST(m{i} AS DOUBLE) AS m{i}" for i in range(P))
    cov = ", ".join((f"CASE WHEN st = 1 THEN 1048576.0 ELSE power(1.4826 * s{i}, 2) END AS c{i}{j}" if i == j else f"CAST(0 AS DOUBLE) AS c{i}{j}") for i, j in _pairs())
    ms = ", ".join(f"m.m{i}" for i in range(P))
    return f"""
        SELECT g1, g2, st, {means}, {cov}
        FROM (SELECT m.g1, m.g2, {ms}, {mad} FROM {vectors} v JOIN {medians} m ON v.g1 = m.g1 AND v.g2 = m.g2 GROUP BY m.g1, m.g2, {ms}) z
        CROSS JOIN (SELECT 0 AS st UNION ALL SELECT 1 AS st) k"""


def factor_sql(state: str) -> str:
    """Cholesky factors of the covariances plus the squared ridge, and the log determinants."""
    out = "SELECT *, " + ", ".join(f"c{i}{j}" + (f" + {(1024 * RIDGE) ** 2}" if i == j else "") + f" AS a{i}{j}" for i, j in _pairs()) + f" FROM {state}"
    for i in range(P):
        for j in range(i + 1):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            e = f"sqrt(greatest(1e-9, a{i}{j}{inner}))" if i == j else f"(a{i}{j}{inner}) / l{j}{j}"
            out = f"SELECT *, {e} AS l{i}{j} FROM ({out}) f{i}{j}"
    det = " + ".join(f"ln(l{i}{i})" for i in range(P))
    keep = ", ".join([f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in _pairs()])
    return f"SELECT g1, g2, st, {keep}, {det} AS det FROM ({out}) f"


def distance_sql(vectors: str, factors: str, keep: str, kind: str = "JOIN") -> str:
    """Squared distances d2 of all vectors, forward substitution by the factor's rows."""
    out = f"SELECT v.*, f.st, {', '.join(f'f.m{i}' for i in range(P))}, {', '.join(f'f.l{i}{j}' for i, j in _pairs())} FROM {vectors} v {kind} {factors} f ON v.g1 = f.g1 AND v.g2 = f.g2"
    for i in range(P):
        inner = "".join(f" - l{i}{k} * y{k}" for k in range(i))
        out = f"SELECT *, (q{i} - m{i}{inner}) / l{i}{i} AS y{i} FROM ({out}) s{i}"
    return f"SELECT {keep}, {' + '.join(f'y{i} * y{i}' for i in range(P))} AS d2 FROM ({out}) d"


def _binned(vectors: str, factors: str) -> str:
    """Distances in steps of their logarithm: some 2,000 at most, so percentiles are exact in bounded memory."""
    q = ", ".join(f"q{i}" for i in range(P))
    return f"SELECT *, CAST(floor(64 * ln(1 + d2)) AS BIGINT) AS b FROM ({distance_sql(vectors, factors, f'g1, g2, st, {q}')}) n"


def cut_sql(vectors: str, factors: str) -> str:
    """The distances within which the nearest SUBSET and the nearest half of each group and start lie."""
    return f"""
        SELECT g1, g2, st, percentile_disc({SUBSET}) WITHIN GROUP (ORDER BY b) AS cut, percentile_disc(0.5) WITHIN GROUP (ORDER BY b) AS half
        FROM ({_binned(vectors, factors)}) c GROUP BY g1, g2, st"""


def step_sql(vectors: str, factors: str, cuts: str) -> str:
    """One concentration step: means and covariances of the documents within the cut."""
    sums = ", ".join([f"CAST(sum(q{i}) AS DOUBLE) / count(*) AS m{i}" for i in range(P)] + [f"CAST(sum(q{i} * q{j}) AS DOUBLE) / count(*) AS x{i}{j}" for i, j in _pairs()])
    cov = ", ".join(f"x{i}{j} - m{i} * m{j} AS c{i}{j}" for i, j in _pairs())
    return f"""
        SELECT g1, g2, st, {', '.join(f'm{i}' for i in range(P))}, {cov}
        FROM (SELECT n.g1, n.g2, n.st, {sums} FROM ({_binned(vectors, factors)}) n JOIN {cuts} c ON n.g1 = c.g1 AND n.g2 = c.g2 AND n.st = c.st WHERE n.b <= c.cut GROUP BY n.g1, n.g2, n.st) s"""


def best_sql(factors: str, cuts: str) -> str:
    """Each group's better start (least determinant, then the first), scaled so that the median distance is the usual one."""
    scale = f"sqrt((exp((half + 0.5) / 64.0) - 1) / {MEDIAN})"
    scaled = ", ".join([f"m{i}" for i in range(P)] + [f"l{i}{j} * {scale} AS l{i}{j}" for i, j in _pairs()])
    return f"""
        SELECT g1, g2, st, {scaled} FROM (
          SELECT f.*, greatest(c.half, 16) AS half, row_number() OVER (PARTITION BY f.g1, f.g2 ORDER BY f.det, f.st) AS rn
          FROM {factors} f JOIN {cuts} c ON f.g1 = c.g1 AND f.g2 = c.g2 AND f.st = c.st) b
        WHERE rn = 1"""


_COUNTS = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"


def verdict_sql(vectors: str, best: str) -> str:
    far = distance_sql(vectors, best, f"doc_id, lang, source, {_COUNTS}", "LEFT JOIN")
    return f"SELECT doc_id, lang, source, {_COUNTS}, d2 AS distance2, (NOT base_failed AND coalesce(d2 <= {CUTOFF}, false)) AS kept FROM ({far}) w"


def assess(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) -> doc_id, the counts, base_failed, distance2 and kept; a row per input row.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups of their own;
    groups under LEAST documents are pooled. Every row has its own verdict, whether its doc_id is null or repeated.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = written(base_counts(docs).withColumn("base_failed", F.expr(BASE_FAILED)), "rules-base")
    # tables of a row per group are written first: joins with them then need no shuffle of documents by group
    counts = written(spark.sql(counts_sql("{base}"), base=base), "rules-counts")
    rows = spark.sql(vectors_sql("{base}", "{c}"), base=base, c=counts)
    vectors = written(spark.sql(distinct_sql("{v}"), v=rows), "rules-vectors")
    medians = written(spark.sql(medians_sql("{v}"), v=vectors), "rules-medians")
    state = written(spark.sql(start_sql("{v}", "{m}"), v=vectors, m=medians), "rules-state")
    spent = [vectors, medians, state]
    for step in range(STEPS + 1):
        factors = written(spark.sql(factor_sql("{s}"), s=state), "rules-factors")
        cuts = written(spark.sql(cut_sql("{v}", "{f}"), v=vectors, f=factors), "rules-cuts")
        if step < STEPS:
            state = written(spark.sql(step_sql("{v}", "{f}", "{c}"), v=vectors, f=factors, c=cuts), "rules-state")
        spent += [factors, cuts, state]
    best = written(spark.sql(best_sql("{f}", "{c}"), f=factors, c=cuts), "rules-best")
    for t in {id(t): t for t in spent}.values():
        discard(t)
    return spark.sql(verdict_sql("{v}", "{b}"), v=rows, b=best)


def oracle_sql() -> str:
    """The same verdicts as one DuckDB statement."""
    gap = r"[\x20\x09-\x0D]"
    ctes = [
        ("t", f"SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents"),
        ("p", "SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM t, unnest(range(1, len(ws) - 3)) AS r(i)"),
        ("dup", "SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1"),
        ("rep", "SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, range(5) AS x(o) GROUP BY doc_id"),
        ("counts", f"""SELECT t.doc_id, t.lang, t.source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{gap}+', '', 'g'))::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
            (length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g')))::BIGINT AS n_punct, (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
            len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT AS n_lines,
            coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id"""),
        ("base", f"SELECT *, ({BASE_FAILED}) AS base_failed FROM counts"),
        ("groups", counts_sql("base")),
        ("docs", vectors_sql("base", "groups")),
        ("vec", distinct_sql("docs")),
        ("med", medians_sql("vec")),
        ("s0", start_sql("vec", "med")),
    ]
    for k in range(STEPS + 1):
        ctes += [(f"f{k}", factor_sql(f"s{k}")), (f"k{k}", cut_sql("vec", f"f{k}"))]
        if k < STEPS:
            ctes.append((f"s{k + 1}", step_sql("vec", f"f{k}", f"k{k}")))
    ctes.append(("best", best_sql(f"f{STEPS}", f"k{STEPS}")))
    head = "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in ctes)
    return f"{head} SELECT doc_id, {_COUNTS}, kept FROM ({verdict_sql("docs", "best")}) z"
