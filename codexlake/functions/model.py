"""The bibliographic record: schema, vocabularies and the predicates every report shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSON = "struct<family:string,given:string,orcid:string,affiliation:string>"

_PERSON = T.StructType([T.StructField(n, T.StringType()) for n in ("family", "given", "orcid", "affiliation")])
_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "people": T.ArrayType(_PERSON), "strings": T.ArrayType(T.StringType()), "scores": T.MapType(T.StringType(), T.DoubleType()),
}


def schema(columns: str) -> T.StructType:
    """A schema of 'name kind' pairs (no session needed); people, strings and scores are the nested kinds."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.replace("\n", " ").split(","))])


#: One row of `refs`.
REFS = schema(
    """id string, doi string, pmid string, pmcid string, arxiv_id string, isbn string, issn string, eissn string, url string,
    oa_url string, title string, authors people, editors people, year int, month int, abstract string, ref_type string,
    journal string, journal_abbrev string, container_title string, volume string, issue string, pages string, article_number string,
    event_name string, publisher string, place string, edition string, series string, num_pages int, keywords strings,
    language string, open_access boolean, license string, citation_count int, sources scores, extras string,
    completeness double, cite_key string, notes string, status string, pdf_local string, pdf_drive_id string, pdf_path string,
    created_at timestamp, updated_at timestamp"""
)

# The closed vocabulary of record types and their codes in other formats.
REF_TYPES = ("journal-article", "book", "book-chapter", "conference-paper", "preprint", "thesis", "dataset", "report", "website", "other", "unknown")
RIS_OF_TYPE = {
    "journal-article": "JOUR", "book": "BOOK", "book-chapter": "CHAP", "conference-paper": "CONF", "preprint": "UNPB", "thesis": "THES",
    "dataset": "DATA", "report": "RPRT", "website": "ELEC", "other": "GEN", "unknown": "GEN",
}
TYPE_OF_RIS = {
    "JOUR": "journal-article", "BOOK": "book", "CHAP": "book-chapter", "CONF": "conference-paper", "THES": "thesis", "RPRT": "report",
    "ELEC": "website", "GEN": "other", "ABST": "journal-article", "UNPB": "preprint",
}
BIBTEX_OF_TYPE = {
    "journal-article": "article", "book": "book", "book-chapter": "incollection", "conference-paper": "inproceedings", "thesis": "phdthesis",
    "report": "techreport",
}
TYPE_OF_BIBTEX = {
    "article": "journal-article", "book": "book", "incollection": "book-chapter", "inbook": "book-chapter", "inproceedings": "conference-paper",
    "conference": "conference-paper", "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report", "online": "website",
}
TYPE_OF_CROSSREF = {
    "journal-article": "journal-article", "book": "book", "book-chapter": "book-chapter", "proceedings-article": "conference-paper",
    "posted-content": "preprint", "dissertation": "thesis", "dataset": "dataset", "report": "report", "reference-entry": "other", "monograph": "book",
}
TYPE_OF_OPENALEX = {
    "journal-article": "journal-article", "book": "book", "book-chapter": "book-chapter", "proceedings-article": "conference-paper", "preprint": "preprint", "dissertation": "thesis", "dataset": "dataset",
    "report": "report", "reference-entry": "other",
}
TYPE_OF_BASE = {
    "11": "book", "111": "book-chapter", "121": "journal-article", "13": "conference-paper", "14": "report", "18": "thesis", "181": "thesis", "182": "thesis", "183": "thesis", "19": "preprint", "7": "dataset",
}
TYPE_OF_CSL = {
    "article-journal": "journal-article", "book": "book", "chapter": "book-chapter", "paper-conference": "conference-paper", "thesis": "thesis",
    "dataset": "dataset", "report": "report", "webpage": "website", "article": "preprint",
}


def lookup(mapping: dict[str, str], key: Column, default: str) -> Column:
    """A dictionary as an expression; broadcast with the plan, never joined."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def filled(name: str | Column) -> Column:
    """Neither null nor empty."""
    c = F.col(name) if isinstance(name, str) else name
    return c.isNotNull() & (c != "")


def has_identifier() -> Column:
    return filled("doi") | filled("pmid") | filled("arxiv_id") | filled("isbn")


def has_authors() -> Column:
    return F.coalesce(F.size("authors") > 0, F.lit(False))


def is_complete() -> Column:
    """Title, an author, and something that identifies or delivers the work."""
    delivered = filled("doi") | filled("isbn") | filled("arxiv_id") | filled("pmid") | filled("url") | filled("oa_url") | filled("pdf_local") | filled("pdf_drive_id")
    return filled("title") & has_authors() & delivered


def is_strictly_complete() -> Column:
    return filled("title") & has_authors() & filled("publisher") & F.col("year").isNotNull() & (filled("url") | filled("doi"))


def tier() -> Column:
    """1 identifier, 2 address, 3 title and context, 4 title, 5 nothing."""
    return (
        F.when(has_identifier(), 1)
        .when(filled("url") | filled("oa_url"), 2)
        .when(filled("title") & (F.col("year").isNotNull() | filled("journal") | filled("container_title")), 3)
        .when(filled("title"), 4)
        .otherwise(5)
    )


def completeness() -> Column:
    """Weighted share of the core fields, at most 1, rounded half-even to four places."""
    light = F.col("ref_type").isin("book", "book-chapter", "preprint")
    part = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), w if isinstance(w, Column) else F.lit(w)).otherwise(F.lit(0.0))
    by_type = lambda a, b: F.when(F.coalesce(light, F.lit(False)), F.lit(a)).otherwise(F.lit(b))
    score = (
        part(filled("title"), 0.22) + part(has_authors(), 0.15) + part(F.col("year").isNotNull() & (F.col("year") != 0), 0.10) + part(has_identifier(), 0.15)
        + part(filled("journal") | filled("container_title") | filled("publisher"), 0.08) + part(filled("title") | filled("abstract"), 0.12)
        + part(filled("volume"), by_type(0.03, 0.05)) + part(filled("issue"), by_type(0.02, 0.04))
        + part(filled("pages") | filled("article_number"), by_type(0.04, 0.05)) + part(F.col("citation_count") > 0, 0.04)
    )
    return F.bround(F.least(F.lit(1.0), score), 4)


def as_refs(df: DataFrame) -> DataFrame:
    """Any subset of the record's columns as full rows, missing ones null; unknown columns are kept in extras as JSON."""
    known = {f.name: f.dataType for f in REFS}
    more = [c for c in df.columns if c not in known]
    extras = F.to_json(F.struct(*more)) if more else F.lit(None).cast("string")
    columns = []
    for name, kind in known.items():
        if name == "extras" and "extras" not in df.columns:
            columns.append(extras.alias(name))
        elif name in df.columns:
            columns.append(F.col(name).cast(kind).alias(name))
        else:
            columns.append(F.lit(None).cast(kind).alias(name))
    return df.select(columns)
