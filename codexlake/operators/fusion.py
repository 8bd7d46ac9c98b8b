"""Record fusion: candidates of one seed become one record, and no filled seed field is lost."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions import text as T
from codexlake.functions.model import REFS, filled
from codexlake.functions.scalar import url_rank

# Providers from the most to the least trusted.
PROVIDER_PRIORITY = {"crossref": 1, "pubmed": 2, "openalex": 3, "semantic_scholar": 4, "doi_org": 5, "arxiv": 6, "dblp": 7, "unpaywall": 8, "google_books": 9, "openlibrary": 10}
SCALARS = tuple(f.name for f in REFS if f.dataType.simpleString() in ("string", "int") and f.name not in ("id", "url", "abstract", "extras", "cite_key", "notes", "status", "created_at", "updated_at", "citation_count"))
PERSONS = "array<struct<family:string,given:string,orcid:string,affiliation:string>>"


def effective_confidence(sources: Column, confidence: Column) -> Column:
    """Confidence and a bonus up to 0.05 for the most trusted provider that contributed."""
    rank = F.create_map(*[F.lit(x) for kv in PROVIDER_PRIORITY.items() for x in kv])
    best = F.array_min(F.transform(F.map_keys(sources), lambda s: F.coalesce(F.try_element_at(rank, s), F.lit(50))))
    return confidence + F.greatest(F.lit(0.0), (100 - F.coalesce(best, F.lit(99))) / 2000.0)


def filter_candidates(rows: DataFrame) -> DataFrame:
    """rows(seed_id, pos, confidence, is_seed, <record>) without candidates whose title is another work's.

    75 by token-sort ratio; 90 where the seed is nothing but a title of under 45 characters.
    """
    anchored = F.col("year").isNotNull() | F.coalesce(F.size("authors") > 0, F.lit(False)) | filled("doi") | filled("pmid") | filled("arxiv_id") | filled("isbn")
    seed = rows.filter("is_seed").select("seed_id", F.col("title").alias("_t"), F.when(~F.coalesce(anchored, F.lit(False)) & (F.length("title") < 45), 90).otherwise(75).alias("_least"))
    x = rows.join(seed, "seed_id", "left")
    ok = F.col("is_seed") | ~F.coalesce(filled("_t"), F.lit(False)) | ~F.coalesce(filled("title"), F.lit(False)) | (T.udf_token_sort()(F.lower("_t"), F.lower("title")) >= F.col("_least"))
    return x.filter(ok).drop("_t", "_least")


def merge_people(lists: list[list[dict]], confidence: list[float]) -> list[dict]:
    """The best list of people, back-filled and extended from the others.

    Best: most ORCIDs, then richness per person, length and confidence. People match by family name and initial.
    """
    def rich(p):
        return len(p.get("given") or "") + len(p.get("family") or "") + (20 if p.get("orcid") else 0) + (10 if p.get("affiliation") else 0)

    def worth(i):
        people = lists[i]
        return 100 * sum(bool(p.get("orcid")) for p in people) + sum(map(rich, people)) / max(1, len(people)) + 2 * len(people) + 10 * confidence[i]

    order = sorted((i for i in range(len(lists)) if lists[i]), key=worth, reverse=True)
    out: list[dict] = []
    at: dict[tuple[str, str], int] = {}
    for n, i in enumerate(order):
        for p in lists[i]:
            key = ((p.get("family") or "").lower().strip(), (p.get("given") or "").lower().strip()[:1])
            if n and key in at:
                mine = out[at[key]]
                for f in ("orcid", "affiliation"):
                    mine[f] = mine[f] or p.get(f)
                for f in ("given", "family"):
                    mine[f] = max(mine[f], p.get(f), key=lambda s: len(s or ""))
            elif not n or key != ("", ""):
                at.setdefault(key, len(out))
                out.append({f: p.get(f) for f in ("family", "given", "orcid", "affiliation")})
    return out


def _people(column: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        lists = [[dict(p.asDict() if hasattr(p, "asDict") else p) for p in (x if x is not None else [])] for x in pdf[column]]
        return pd.DataFrame({"seed_id": [pdf["seed_id"].iloc[0]], column: [merge_people(lists, pdf["eff"].tolist())]})

    return run


def fuse(candidates: DataFrame) -> DataFrame:
    """candidates(seed_id, pos, confidence, is_seed, <record columns>) -> one record a seed.

    Scalars: the filled value of the highest effective confidence, the first of equals. Address by rank then confidence,
    the longest abstract, keywords united, open access if any says so, citations and provider scores at their maximum.
    One aggregation by seed for all of these; only lists of people, whose fusion depends on order, go through a grouped
    function (a seed has a handful of candidates).
    """
    rows = filter_candidates(candidates)
    rows = rows.withColumn("eff", effective_confidence(F.coalesce("sources", F.create_map().cast("map<string,double>")), F.col("confidence")))
    by = F.struct(F.col("eff").alias("eff"), (-F.col("pos")).alias("pos"))
    usable = lambda c: filled(F.col(c).cast("string")) & (F.col(c) != "unknown" if c == "ref_type" else F.lit(True))
    picked = [F.max_by(c, F.when(usable(c), by)).alias(c) for c in SCALARS if c in rows.columns]
    picked += [
        F.max_by("url", F.when(filled("url"), F.struct(url_rank(F.col("url")), F.col("eff"), -F.col("pos")))).alias("url"), F.max_by("abstract", F.when(filled("abstract"), F.struct(F.length("abstract"), F.col("eff"), -F.col("pos")))).alias("abstract"),
        F.bool_or("open_access").alias("open_access"), F.max("citation_count").alias("citation_count"),
    ]
    out = rows.groupBy("seed_id").agg(*picked)
    from codexlake.operators.aggregates import merge_keywords, merge_sources

    out = out.join(merge_keywords(rows, "seed_id", "keywords", "pos"), "seed_id", "left").join(merge_sources(rows, "seed_id", "sources"), "seed_id", "left")
    for column in ("authors", "editors"):
        if column in rows.columns:
            people = rows.select("seed_id", "pos", "eff", column).groupBy("seed_id").applyInPandas(_people(column), f"seed_id string, {column} {PERSONS}")
            out = out.join(people, "seed_id", "left")
    return out


def merge_two(keep: DataFrame, other: DataFrame) -> DataFrame:
    """Two versions of a record: the more complete (then more cited) one counts 0.5, the other 0.1."""
    rows = keep.withColumns({"seed_id": F.col("id"), "_k": F.lit(0)}).unionByName(other.withColumns({"seed_id": F.col("id"), "_k": F.lit(1)}))
    from pyspark.sql import Window

    better = Window.partitionBy("seed_id").orderBy(F.desc_nulls_last("completeness"), F.desc_nulls_last("citation_count"), "_k")
    rows = rows.withColumn("pos", F.row_number().over(better) - 1)
    return fuse(rows.withColumns({"confidence": F.when(F.col("pos") == 0, 0.5).otherwise(0.1), "is_seed": F.col("pos") == 0}).drop("id", "_k"))


def with_overrides(base: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """A manual choice wins over what the rules made."""
    from codexlake.operators.relational import sparse_update

    return sparse_update(base, overrides, key)


def match_score(title_ratio: Column, year_a: Column, year_b: Column, author_a: Column, author_b: Column, doi_a: Column, doi_b: Column) -> Column:
    """1 or 0 where both have a DOI, else the mean of title, year and first author where known."""
    both_doi = filled(doi_a) & filled(doi_b)
    parts = [title_ratio / 100.0, F.when(year_a.isNotNull() & year_b.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(year_a - year_b) / 3.0)), F.when(filled(author_a) & filled(author_b), (F.lower(author_a) == F.lower(author_b)).cast("double"))]
    known = F.array_compact(F.array(*parts))
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(known), F.lit(1))
    return F.when(F.coalesce(both_doi, F.lit(False)), (F.lower(doi_a) == F.lower(doi_b)).cast("double")).otherwise(mean)


def logistic(features: Column, weights: list[float], bias: float) -> Column:
    """1 / (1 + exp(-(w . x + b))) of an array of features."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    z = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))
