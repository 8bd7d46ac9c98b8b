"""Full-text search: postings, BM25, filters, fusion. An index is three DataFrames, rebuilt or patched by key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.sources.tables import settled

K1, B = 1.2, 0.75
#: Words of the passage query: letters, digits, hyphens, longer than one, so many at most.
QUERY_TERMS = 32
#: Pairs of a query and a term up to which they go to every task.
SENT_TERMS = 100_000


@dataclass
class Index:
    postings: DataFrame  # doc, term, tf
    lengths: DataFrame  # doc, dl
    terms: DataFrame  # term, df


def tokens(text: Column) -> Column:
    """Lower-case words of [A-Za-z0-9_-] and other letters, longer than one character."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\-]+"), lambda w: F.length(w) > 1)


def ref_document() -> Column:
    """The searchable text of a record."""
    people = F.array_join(F.transform("authors", lambda a: F.concat_ws(" ", a["given"], a["family"])), " ")
    return F.concat_ws(" ", "title", "abstract", people, F.array_join("keywords", " "), "journal", "doi", "arxiv_id", "isbn")


def build_index(docs: DataFrame, doc: str, text: str, stem=None) -> Index:
    """Postings of docs(doc, text); `stem` maps the token array (an Arrow UDF), off by default."""
    ws = tokens(F.col(text))
    words = docs.select(F.col(doc).alias("doc"), (stem(ws) if stem else ws).alias("ws"))
    postings = words.select("doc", F.explode("ws").alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = words.select("doc", F.size("ws").cast("long").alias("dl"))
    return Index(postings, lengths, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def patch_index(index: Index, changed: DataFrame, docs: DataFrame, doc: str, text: str) -> Index:
    """The index with only the changed documents' rows made anew."""
    ids = changed.select(F.col(doc).alias("doc"))
    new = build_index(docs.join(changed.select(doc), doc, "left_semi"), doc, text)
    postings = index.postings.join(ids, "doc", "left_anti").unionByName(new.postings)
    return Index(postings, index.lengths.join(ids, "doc", "left_anti").unionByName(new.lengths), postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def query_terms(query: str) -> list[str]:
    """Distinct words of a query, in order, at most QUERY_TERMS."""
    import re

    return list(dict.fromkeys(w for w in re.findall(r"[^\W]+(?:-[^\W]+)*", query.lower()) if len(w) > 1))[:QUERY_TERMS]


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """queries(qid, term) -> qid, doc, score over documents with any of the terms; larger is better.

    Query terms select postings first, so only matching postings meet lengths and statistics.
    """
    stats = index.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    want = queries.select("qid", "term").distinct().join(index.terms, "term")
    hits = index.postings.join(want, "term").join(index.lengths, "doc").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", "doc").agg(F.sum(idf * weight).alias("score"), F.count(F.lit(1)).alias("matched"))


def bm25_once(docs: DataFrame, doc: str, text: str, queries: DataFrame) -> DataFrame:
    """bm25() without an index: texts are cut into words once, and only words that a query has are kept.

    Texts are dealt by document before they are cut, so their words are not dealt again, and what is one row a query and
    term goes to every task. The word of no letters, once in each text, counts all of them.
    """
    want = settled(queries.select("qid", "term").filter("term <> ''").distinct())
    sent = F.broadcast if want.count() <= SENT_TERMS else (lambda df: df)
    known = want.select("term").distinct().unionByName(want.sparkSession.createDataFrame([("",)], "term string"))
    words = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).repartition("doc").select("doc", tokens(F.col("text")).alias("ws"))
    hits = words.select("doc", F.size("ws").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "ws")).alias("term")).join(sent(known), "term", "left_semi")
    postings = settled(hits.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"), F.sum("dl").alias("all")))
    stats = postings.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum("all") / F.sum("tf")).alias("avgdl"))
    df = postings.filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    asked = want.join(df, "term").join(F.broadcast(stats)).select("qid", "term", idf.alias("idf"), "avgdl")  # one row
    return postings.join(sent(asked), "term").groupBy("qid", "doc").agg(F.sum(F.col("idf") * weight).alias("score"), F.count(F.lit(1)).alias("matched"))


def search_all_prefixes(index: Index, words: Sequence[str]) -> DataFrame:
    """Library search: every word a prefix of some term (AND), ranked by BM25 of the terms found."""
    words = list(dict.fromkeys(w.lower() for w in words if w))
    spark = index.terms.sparkSession
    prefixes = spark.createDataFrame([(w,) for w in words], "prefix string")
    found = index.terms.join(F.broadcast(prefixes), F.startswith("term", F.col("prefix"))).select("term", "prefix")
    whole = index.postings.join(found, "term").groupBy("doc").agg(F.countDistinct("prefix").alias("n")).filter(F.col("n") == len(words)).select("doc")
    scored = bm25(index, found.select(F.lit(0).alias("qid"), "term"))
    return scored.join(whole, "doc", "left_semi").select("doc", "score")


def search_notes(notes: DataFrame, query: str, n: int = 10, project: str | None = None, include_inactive: bool = False) -> DataFrame:
    """notes(id, project, status, claim, ...) with `score`: the n best for any of the query's words, active ones and one project's if asked.

    Statistics are those of all notes; the filters only choose among the hits.
    """
    terms = notes.sparkSession.createDataFrame([(0, w) for w in query_terms(query)], "qid int, term string")
    hits = bm25_once(notes, "id", "claim", terms).select(F.col("doc").alias("id"), "score")
    for cond in (None if project is None else F.col("project") == project, None if include_inactive else F.col("status") == "active"):
        if cond is not None:
            notes = notes.filter(cond)
    return notes.join(hits, "id").orderBy(F.round("score", 9).desc(), "id").limit(n)


def fallback(docs: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Substring search for queries that cannot be parsed; score 0.5."""
    safe = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).ilike(f"%{safe}%")
    return docs.filter(cond).withColumn("score", F.lit(0.5))


def highlight(text: Column, words: Sequence[str]) -> Column:
    import re

    pattern = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)({pattern})", "<mark>$1</mark>") if pattern else text
