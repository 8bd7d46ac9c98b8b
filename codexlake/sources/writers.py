"""Writers: one text a record as a column expression, so exports run in parallel and end in write.text()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.functions.model import BIBTEX_OF_TYPE, RIS_OF_TYPE, filled, lookup
from codexlake.functions.scalar import cite_key


def _given_first(a: Column) -> Column:
    return F.concat_ws(", ", a["family"], a["given"])


def _tex(c: Column) -> Column:
    for old, new in (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("#", "\\#"), ("_", "\\_"), ("$", "\\$")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _guard_case(c: Column) -> Column:
    """Words with an inner capital are braced."""
    return F.regexp_replace(c, r"(?U)\b(\w+\p{Lu}\w*)\b", "{$1}")


def _percent(share: Column) -> Column:
    """A share in whole percent, halves away from zero; what rounds to nothing has no sign."""
    return F.format_string("%.0f%%", F.round(share * 100) + 0.0)


def bibtex(protect_case: bool = True) -> Column:
    """One BibTeX entry with aligned fields."""
    title = _tex(F.col("title"))
    fields = [
        ("title", _guard_case(title) if protect_case else title), ("author", _tex(F.nullif(F.array_join(F.transform("authors", _given_first), " and "), F.lit("")))), ("editor", _tex(F.nullif(F.array_join(F.transform("editors", _given_first), " and "), F.lit("")))), ("year", F.col("year").cast("string")),
        ("month", F.col("month").cast("string")), ("journal", _tex(F.col("journal"))), ("booktitle", _tex(F.when(F.col("ref_type").isin("book-chapter", "conference-paper"), F.coalesce("container_title", "event_name")))), ("volume", F.col("volume")), ("number", F.col("issue")),
        ("pages", F.regexp_replace("pages", r"\s*[-–]+\s*", "--")), ("publisher", _tex(F.col("publisher"))), ("address", _tex(F.col("place"))), ("edition", F.col("edition")), ("series", _tex(F.col("series"))), ("doi", F.col("doi")), ("url", F.col("url")), ("isbn", F.col("isbn")), ("issn", F.col("issn")),
        ("eprint", F.col("arxiv_id")), ("archiveprefix", F.when(filled("arxiv_id"), F.lit("arXiv"))), ("abstract", _tex(F.col("abstract"))), ("keywords", _tex(F.nullif(F.array_join("keywords", ", "), F.lit("")))), ("note", F.when(filled("pmid"), F.concat(F.lit("PMID: "), F.col("pmid")))),
    ]
    lines = [F.when(filled(c), F.concat(F.lit(f"  {n:<13} = {{"), c, F.lit("}"))) for n, c in fields]
    head = F.concat(F.lit("@"), lookup(BIBTEX_OF_TYPE, F.col("ref_type"), "misc"), F.lit("{"), cite_key(), F.lit(",\n"))
    return F.concat(head, F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit("\n}\n"))


def ris() -> Column:
    """One RIS record."""
    start = F.nullif(F.trim(F.regexp_extract("pages", r"^([^-–]+)", 1)), F.lit(""))
    end = F.nullif(F.trim(F.regexp_extract("pages", r"[-–]+(.+)$", 1)), F.lit(""))
    one = lambda tag, c: F.when(filled(c), F.array(F.concat(F.lit(f"{tag}  - "), c))).otherwise(F.array().cast("array<string>"))
    many = lambda tag, c: F.coalesce(F.transform(c, lambda x: F.concat(F.lit(f"{tag}  - "), x)), F.array().cast("array<string>"))
    parts = [
        F.array(F.concat(F.lit("TY  - "), lookup(RIS_OF_TYPE, F.col("ref_type"), "GEN"))), one("TI", F.col("title")), many("AU", F.transform("authors", _given_first)), many("ED", F.transform("editors", _given_first)), one("PY", F.col("year").cast("string")), one("JO", F.col("journal")),
        one("T2", F.coalesce("container_title", "event_name")), one("VL", F.col("volume")), one("IS", F.col("issue")), one("SP", start), one("EP", end), one("PB", F.col("publisher")), one("CY", F.col("place")), one("SN", F.coalesce("isbn", "issn")), one("DO", F.col("doi")), one("UR", F.col("url")),
        one("AB", F.regexp_replace("abstract", r"\s+", " ")), many("KW", F.col("keywords")), one("LA", F.col("language")), F.array(F.lit("ER  - ")),
    ]
    return F.concat(F.array_join(F.concat(*parts), "\n"), F.lit("\n"))


def markdown(number: Column | None = None) -> Column:
    """One Markdown section with a bar of completeness and the sources by score."""
    score = F.coalesce("completeness", F.lit(0.0))
    full = F.round(score * 10).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 10 - full))
    sources = F.array_sort(F.transform(F.map_entries("sources"), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    head = F.concat(F.lit("## "), F.concat(number.cast("string"), F.lit(". ")) if number is not None else F.lit(""), F.coalesce("title", F.lit("(untitled)")))
    line = lambda name, c: F.when(filled(c), F.concat(F.lit(f"- **{name}**: "), c))
    rest = F.array(
        line("Authors", F.array_join(F.transform("authors", lambda a: F.concat_ws(" ", a["given"], a["family"])), ", ")), line("Year", F.col("year").cast("string")), line("Venue", F.coalesce("journal", "container_title")), line("DOI", F.concat(F.lit("[" ), F.col("doi"), F.lit("](https://doi.org/"), F.col("doi"), F.lit(")"))),
        line("URL", F.col("url")), line("Keywords", F.array_join("keywords", ", ")), F.concat(F.lit("- **Completeness**: "), bar, F.lit(" "), _percent(score)), line("Sources", F.array_join(F.transform(sources, lambda s: F.format_string("%s (%.2f)", s["k"], -s["s"])), ", ")), F.when(filled("abstract"), F.concat(F.lit("\n> "), F.col("abstract"))),
    )
    return F.concat(head, F.lit("\n\n"), F.array_join(F.array_compact(rest), "\n"), F.lit("\n"))


def _xml(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def zotero_rdf() -> Column:
    """One item of a Zotero RDF file (without the root element)."""
    uri = F.coalesce(F.concat(F.lit("https://doi.org/"), F.col("doi")), F.col("url"), F.concat(F.lit("urn:isbn:"), F.col("isbn")), F.concat(F.lit("#"), cite_key()))
    one = lambda tag, c: F.when(filled(c), F.concat(F.lit(f"  <{tag}>"), _xml(c), F.lit(f"</{tag}>")))
    persons = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<rdf:li><foaf:Person><foaf:surname>"), _xml(F.coalesce(a["family"], F.lit(""))), F.lit("</foaf:surname><foaf:givenName>"), _xml(F.coalesce(a["given"], F.lit(""))), F.lit("</foaf:givenName></foaf:Person></rdf:li>"))), "")
    kind = F.when(F.col("ref_type").isin("book", "thesis", "report"), "bib:Book").when(F.col("ref_type").isin("book-chapter"), "bib:BookSection").when(F.col("ref_type") == "website", "bib:Document").otherwise("bib:Article")
    parts = F.array(one("z:itemType", F.col("ref_type")), one("dc:title", F.col("title")), F.when(filled(persons), F.concat(F.lit("  <bib:authors><rdf:Seq>"), persons, F.lit("</rdf:Seq></bib:authors>"))), one("dc:date", F.col("year").cast("string")), one("dcterms:isPartOf", F.col("journal")), one("prism:volume", F.col("volume")), one("prism:number", F.col("issue")), one("bib:pages", F.col("pages")), one("dc:publisher", F.col("publisher")), one("dc:identifier", F.concat(F.lit("DOI "), F.col("doi"))), one("dcterms:abstract", F.col("abstract")))
    return F.concat(F.lit("<"), kind, F.lit(' rdf:about="'), _xml(uri), F.lit('">\n'), F.array_join(F.array_compact(parts), "\n"), F.lit("\n</"), kind, F.lit(">"))


RDF_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:z="http://www.zotero.org/namespaces/export#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:bib="http://purl.org/net/biblio#" xmlns:foaf="http://xmlns.com/foaf/0.1/" xmlns:prism="http://prismstandard.org/namespaces/1.2/basic/">'


def json_line() -> Column:
    return F.to_json(F.struct("*"))


def flat(refs: DataFrame) -> DataFrame:
    """Records for CSV: lists joined by semicolons, completeness in percent."""
    people = lambda c: F.array_join(F.transform(c, _given_first), "; ")
    out = refs.withColumns({"authors": people("authors"), "editors": people("editors"), "keywords": F.array_join("keywords", "; "), "sources": F.array_join(F.array_sort(F.map_keys("sources")), "; "), "completeness": _percent(F.coalesce("completeness", F.lit(0.0)))})
    return out


FORMATS = {"bibtex": bibtex, "ris": ris, "markdown": markdown, "rdf": zotero_rdf, "json": json_line}


def write(refs: DataFrame, path: str, fmt: str, mode: str = "error") -> None:
    """Write records in a text format, or as CSV with a header."""
    if fmt == "csv":
        flat(refs).write.mode(mode).option("header", True).option("quoteAll", True).csv(path)
    else:
        refs.select(FORMATS[fmt]().alias("value")).write.mode(mode).text(path)


def notes_document(notes: DataFrame) -> DataFrame:
    """project -> one Markdown document of its claims in order, superseded ones struck through."""
    dead = notes.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("note_id")).distinct().withColumn("_dead", F.lit(True))
    line = F.concat(F.lit("- "), F.when(F.col("_dead"), F.concat(F.lit("~~"), F.col("claim"), F.lit("~~"))).otherwise(F.col("claim")), F.when(filled("quote"), F.concat(F.lit("\n  > "), F.col("quote"))).otherwise(""))
    x = notes.join(dead, "note_id", "left").select("project", F.struct("note_id", line.alias("line")).alias("n"))
    return x.groupBy("project").agg(F.concat(F.lit("# "), F.first("project"), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["line"]), "\n")).alias("value"))


def push_split(refs: DataFrame, key: str = "zotero_item_key") -> tuple[DataFrame, DataFrame]:
    """(to create, to update) payloads for an external library, by whether a record has its key there."""
    payload = F.to_json(F.struct("title", "doi", "year", "url"))
    has = filled(key)
    return refs.filter(~F.coalesce(has, F.lit(False))).select("id", payload.alias("payload")), refs.filter(has).select("id", key, payload.alias("payload"))
