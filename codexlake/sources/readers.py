"""Readers: text formats and provider payloads to records.

Whole files (or payloads) are rows; a file is split inside its task by plain functions, and everything after that is
column expressions on as_refs(). The functions are public, so tests call them directly.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.functions.model import TYPE_OF_BASE, TYPE_OF_BIBTEX, TYPE_OF_CROSSREF, TYPE_OF_CSL, TYPE_OF_OPENALEX, TYPE_OF_RIS, as_refs, lookup, schema

#: What the splitters give for each record.
RAW = schema(
    """doi string, pmid string, pmcid string, arxiv_id string, isbn string, issn string, url string, oa_url string, title string, authors people, editors people,
    year int, month int, abstract string, ref_type string, journal string, container_title string, volume string, issue string, pages string, event_name string,
    publisher string, place string, edition string, series string, num_pages int, keywords strings, language string, open_access boolean, license string,
    citation_count int, cite_key string, notes string, extras string"""
)
_RAW = RAW.names
_ARXIV = re.compile(r"(?i)(?:arxiv[:\s./]*(?:abs/|pdf/)?|abs/)(\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?")
_DOI = re.compile(r"\b(10\.\d{4,9}/[^\s,;}\"'<>|\])]+)")


def person(name: str) -> dict:
    name = " ".join(name.split())
    if "," in name:
        family, given = (p.strip() for p in name.split(",", 1))
    else:
        given, _, family = name.rpartition(" ")
    return {"family": family, "given": given or None, "orcid": None, "affiliation": None}


def bare_doi(s: str | None) -> str | None:
    m = _DOI.search(s or "")
    return m[1].rstrip(".").lower() if m else None


def _int(s) -> int | None:
    m = re.search(r"\d+", str(s or ""))
    return int(m[0]) if m else None


# ---- BibTeX ----------------------------------------------------------------------------------------------------------

_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def bibtex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of every entry; values may be braced, quoted, bare or joined by #."""
    for m in re.finditer(r"@(\w+)\s*[{(]", text):
        kind = m[1].lower()
        if kind in ("comment", "preamble", "string"):
            continue
        at, depth = m.end(), 1
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0) if text[at - 1] != "\\" else 0
            at += 1
        body = text[m.end() : at - 1]
        key, _, rest = body.partition(",")
        fields: dict[str, str] = {}
        pos = 0
        while True:
            f = re.compile(r"\s*([\w-]+)\s*=\s*").match(rest, pos)
            if not f:
                break
            pos, parts = f.end(), []
            while pos < len(rest):
                if rest[pos] == "{":
                    end, depth = pos + 1, 1
                    while end < len(rest) and depth:
                        depth += {"{": 1, "}": -1}.get(rest[end], 0)
                        end += 1
                    parts.append(rest[pos + 1 : end - 1])
                elif rest[pos] == '"':
                    end = pos + 1
                    while end < len(rest) and rest[end] != '"':
                        end += 1
                    parts.append(rest[pos + 1 : end])
                    end += 1
                else:
                    end = re.compile(r"[^,#\s]*").match(rest, pos).end()
                    parts.append(rest[pos:end])
                pos = end
                joined = re.compile(r"\s*#\s*").match(rest, pos)
                if not joined:
                    break
                pos = joined.end()
            fields[f[1].lower()] = "".join(parts)
            comma = re.compile(r"\s*,").match(rest, pos)
            if not comma:
                break
            pos = comma.end()
        yield kind, key.strip(), fields


_ACCENT = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "c": "\u0327", "v": "\u030c", "=": "\u0304", ".": "\u0307", "u": "\u0306", "H": "\u030b", "r": "\u030a"}


def untex(s: str | None) -> str | None:
    """Accents composed, commands and braces off."""
    if s is None:
        return None
    import unicodedata

    s = re.sub(r"\\([`'^~\"=.]|[cvuHr](?=[{\s]))\s*\{?\\?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2] + _ACCENT[m[1]]), s)
    s = re.sub(r"\\url\{([^}]*)\}", r"\1", s)
    for tex, plain in (("\\ss", "ß"), ("\\o", "ø"), ("\\O", "Ø"), ("\\ae", "æ"), ("\\aa", "å"), ("---", "—"), ("--", "–"), ("\\&", "&"), ("\\%", "%"), ("\\_", "_"), ("\\$", "$"), ("\\#", "#")):
        s = s.replace(tex, plain)
    s = re.sub(r"\\[a-zA-Z]+\s*", "", s)
    return " ".join(re.sub(r"[{}]", "", s).split()) or None


def parse_bibtex(text: str) -> list[dict]:
    out = []
    for kind, key, f in bibtex_entries(text):
        people = lambda v: [person(untex(p) or "") for p in re.split(r"\s+and\s+", v.replace("\n", " ")) if p.strip()] if v else None
        arxiv = _ARXIV.search(f"arxiv:{f['eprint']}") if f.get("archiveprefix", "").lower() == "arxiv" or re.match(r"\d{4}\.\d{4,5}", f.get("eprint", "")) else None
        pmid = re.search(r"(?i)pmid:?\s*(\d+)", f.get("note", ""))
        out.append({
            "ref_type": "preprint" if kind == "misc" and arxiv else TYPE_OF_BIBTEX.get(kind, "other"), "cite_key": key or None, "title": untex(f.get("title")), "authors": people(f.get("author")), "editors": people(f.get("editor")),
            "year": _int(f.get("year") or f.get("date")), "month": _MONTHS.get(f.get("month", "").lower()[:3]) or _int(f.get("month")), "journal": untex(f.get("journal") or f.get("journaltitle")), "container_title": untex(f.get("booktitle")),
            "event_name": untex(f.get("booktitle")) if kind in ("inproceedings", "conference") else None, "volume": f.get("volume"), "issue": f.get("number") or f.get("issue"), "pages": (f.get("pages") or "").replace("--", "-").replace("–", "-") or None,
            "publisher": untex(f.get("publisher") or f.get("school") or f.get("institution")), "place": untex(f.get("address")), "edition": untex(f.get("edition")), "series": untex(f.get("series")), "doi": bare_doi(f.get("doi")), "url": untex(f.get("url")),
            "isbn": f.get("isbn"), "issn": f.get("issn"), "arxiv_id": arxiv[1] if arxiv else None, "pmid": f.get("pmid") or (pmid[1] if pmid else None), "abstract": untex(f.get("abstract")), "language": f.get("language"), "notes": untex(f.get("note")),
            "keywords": [k.strip() for k in re.split(r"[,;]", untex(f.get("keywords")) or "") if k.strip()] or None,
        })
    return out


# ---- RIS -------------------------------------------------------------------------------------------------------------


def parse_ris(text: str) -> list[dict]:
    out = []
    for block in re.split(r"(?m)^ER\s*-.*$", text):
        tags: dict[str, list[str]] = {}
        for m in re.finditer(r"(?m)^([A-Z][A-Z0-9])\s{1,2}-\s?(.*)$", block):
            if m[2].strip():
                tags.setdefault(m[1], []).append(m[2].strip())
        if "TY" not in tags:
            continue
        one = lambda *ks: next((tags[k][0] for k in ks if k in tags), None)
        kind = TYPE_OF_RIS.get(tags["TY"][0].upper(), "unknown")
        number = one("SN")
        book = kind in ("book", "book-chapter") or bool(number and re.fullmatch(r"(?:97[89])?\d{9}[\dXx]", re.sub(r"[-\s]", "", number)) and kind != "journal-article")
        pages = "-".join(filter(None, (one("SP"), one("EP")))) or None
        out.append({
            "ref_type": kind, "title": one("TI", "T1", "CT"), "authors": [person(a) for k in ("AU", "A1") for a in tags.get(k, [])] or None, "editors": [person(a) for k in ("ED", "A2") for a in tags.get(k, [])] or None,
            "year": _int(one("PY", "Y1", "DA")), "journal": one("JO", "JF", "T2") if kind != "conference-paper" else None, "event_name": one("T2", "C3") if kind == "conference-paper" else None, "container_title": one("T2", "BT") if kind in ("book-chapter", "conference-paper") else None,
            "volume": one("VL"), "issue": one("IS"), "pages": pages, "publisher": one("PB"), "place": one("CY"), "abstract": one("AB", "N2"), "doi": bare_doi(one("DO")), "url": one("UR"), "keywords": tags.get("KW"), "language": one("LA"),
            "isbn": number if book else None, "issn": number if number and not book else None, "notes": one("N1"), "edition": one("ET"),
        })
    return out


# ---- JSON, Markdown, bookmarks, tables --------------------------------------------------------------------------------


def _csl(d: dict) -> dict:
    parts = ((d.get("issued") or {}).get("date-parts") or [[None]])[0]
    people = lambda v: [{"family": p.get("family") or p.get("literal"), "given": p.get("given"), "orcid": p.get("ORCID"), "affiliation": None} for p in v or []] or None
    return {
        "ref_type": TYPE_OF_CSL.get(d.get("type"), TYPE_OF_CROSSREF.get(d.get("type"), "unknown")), "title": d.get("title"), "authors": people(d.get("author")), "editors": people(d.get("editor")), "year": _int(parts[0] if parts else None),
        "journal": d.get("container-title"), "volume": d.get("volume"), "issue": d.get("issue"), "pages": d.get("page"), "publisher": d.get("publisher"), "doi": bare_doi(d.get("DOI")), "url": d.get("URL"), "isbn": d.get("ISBN"), "issn": d.get("ISSN"), "abstract": d.get("abstract"), "language": d.get("language"),
    }


def parse_json(text: str) -> list[dict]:
    """Own records, CSL-JSON and plain dictionaries, alone, in a list or under items / references / refs; malformed text gives none."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if isinstance(data, dict):
        data = next((data[k] for k in ("items", "references", "refs") if isinstance(data.get(k), list)), [data])
    out = []
    for d in data if isinstance(data, list) else []:
        if not isinstance(d, dict):
            continue
        if "issued" in d or "container-title" in d or "DOI" in d:
            rec = _csl(d)
        else:
            known = set(_RAW)
            rec = {k: v for k, v in d.items() if k in known}
            rec["doi"] = bare_doi(d.get("doi")) or d.get("doi")
            people = d.get("authors") or d.get("author")
            if isinstance(people, str):
                people = re.split(r"\s*;\s*|\s+and\s+", people)
            rec["authors"] = [p if isinstance(p, dict) else person(str(p)) for p in people or []] or None
            rec["year"] = _int(d.get("year"))
            more = {k: v for k, v in d.items() if k not in known and k not in ("author", "id")}
            rec["extras"] = json.dumps(more, sort_keys=True, ensure_ascii=False) if more else None
        out.append(rec)
    return out


def salvage_json(text: str) -> list[dict]:
    """The record in a chatty or fenced answer: from the first brace to the last."""
    m = re.search(r"\{.*\}", text or "", re.S)
    return parse_json(m[0]) if m else []


def parse_markdown(text: str) -> list[dict]:
    """Front-matter blocks between --- lines, then identifiers in the text that no block has."""
    out, rest = [], []
    blocks = re.split(r"(?m)^---\s*$", text)
    for i, b in enumerate(blocks):
        fields = dict(m.groups() for m in re.finditer(r"(?m)^([A-Za-z_]+):\s*(.+?)\s*$", b)) if i % 2 else {}
        fields = {k.lower(): v.strip("\"'") for k, v in fields.items()}
        if not fields.keys() & {"title", "doi", "arxiv", "arxiv_id", "pmid"}:
            rest.append(b)
            continue
        names = re.split(r"\s*[;]\s*|\s+and\s+|,\s(?=\w+\s\w)", fields.get("authors") or fields.get("author") or "")
        out.append({"title": fields.get("title"), "doi": bare_doi(fields.get("doi")), "arxiv_id": fields.get("arxiv") or fields.get("arxiv_id"), "pmid": fields.get("pmid"), "year": _int(fields.get("year")), "journal": fields.get("journal"), "authors": [person(n.strip("[]\"' ")) for n in names if n.strip("[]\"' ")] or None, "url": fields.get("url")})
    seen = {r[k] for r in out for k in ("doi", "arxiv_id", "pmid") if r.get(k)}
    body = "\n".join(rest)
    for key, found in (("doi", (bare_doi(m[0]) for m in _DOI.finditer(body))), ("arxiv_id", (m[1] for m in _ARXIV.finditer(body))), ("pmid", (m[1] for m in re.finditer(r"(?i)PMID:?\s*(\d{6,9})", body)))):
        for v in found:
            if v and v not in seen:
                seen.add(v)
                out.append({key: v})
    return out


class _Bookmarks(HTMLParser):
    def __init__(self):
        super().__init__()
        self.folders: list[str] = []
        self.pending: str | None = None
        self.href: str | None = None
        self.text: list[str] = []
        self.found: list[tuple[str, str, list[str]]] = []
        self.heading = False

    def handle_starttag(self, tag, attrs):
        if tag == "h3":
            self.heading, self.text = True, []
        elif tag == "dl":
            self.folders.append(self.pending or "")
            self.pending = None
        elif tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data):
        self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "h3" and self.heading:
            self.heading, self.pending = False, "".join(self.text).strip()
        elif tag == "dl" and self.folders:
            self.folders.pop()
        elif tag == "a" and self.href:
            self.found.append((self.href, "".join(self.text).strip(), [f for f in self.folders if f]))
            self.href = None


def parse_bookmarks(text: str) -> list[dict]:
    """Netscape bookmarks: folder path as keywords, one record an address (the first), identifiers out of it."""
    p = _Bookmarks()
    p.feed(text)
    p.close()
    out: dict[str, dict] = {}
    for href, title, folders in p.found:
        if href.lower().startswith("http") and href not in out:
            arxiv = _ARXIV.search(href)
            out[href] = {"url": href, "title": " ".join(title.split()) or None, "keywords": folders or None, "doi": bare_doi(href), "arxiv_id": arxiv[1] if arxiv else None, "ref_type": "website"}
    return list(out.values())


def parse_reference_table(text: str) -> list[dict]:
    """Rows of Markdown tables as dictionaries by their header, lower-cased."""
    out: list[dict] = []
    header: list[str] | None = None
    for line in text.splitlines():
        if not line.strip().startswith("|"):
            header = None
            continue
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if header is None:
            header = [c.lower() for c in cells]
        elif not all(re.fullmatch(r":?-+:?", c) for c in cells):
            out.append(dict(zip(header, cells)))
    return out


# ---- HTML metadata in order of trust ----------------------------------------------------------------------------------


class _Meta(HTMLParser):
    def __init__(self):
        super().__init__()
        self.meta: dict[str, list[str]] = {}
        self.blocks: list[str] = []
        self.into: str | None = None
        self.title: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, []).append(a["content"].strip())
        elif tag == "title":
            self.into = "title"
        elif tag == "script" and (a.get("type") or "") == "application/ld+json":
            self.into = "ld"
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in ("title", "script"):
            self.into = None

    def handle_data(self, data):
        if self.into == "title":
            self.title.append(data)
        elif self.into == "ld":
            self.blocks[-1] += data


def parse_html(text: str, source_url: str | None = None) -> list[dict]:
    """One record of a page: Highwire tags, then Dublin Core, JSON-LD, OpenGraph, and what title and address say."""
    p = _Meta()
    p.feed(text)
    p.close()
    one = lambda *ks: next((p.meta[k][0] for k in ks if p.meta.get(k)), None)
    ld: dict = {}
    for b in p.blocks:
        try:
            d = json.loads(b)
        except ValueError:
            continue
        for x in d if isinstance(d, list) else d.get("@graph", [d]) if isinstance(d, dict) else []:
            if isinstance(x, dict) and str(x.get("@type")) in ("ScholarlyArticle", "Article", "Book", "Chapter", "Thesis", "Report", "Dataset", "NewsArticle"):
                ld = ld or x
    names = p.meta.get("citation_author") or p.meta.get("dc.creator") or p.meta.get("dcterms.creator")
    if not names and ld.get("author"):
        a = ld["author"] if isinstance(ld["author"], list) else [ld["author"]]
        names = [x.get("name", "") if isinstance(x, dict) else str(x) for x in a]
    first, last = one("citation_firstpage"), one("citation_lastpage")
    arxiv = _ARXIV.search(f"arxiv:{one('citation_arxiv_id')}") if one("citation_arxiv_id") else _ARXIV.search(source_url or "")
    return [{
        "title": one("citation_title", "dc.title", "dcterms.title") or ld.get("headline") or ld.get("name") or one("og:title") or html.unescape(" ".join("".join(p.title).split())) or None, "authors": [person(n) for n in names or [] if n.strip()] or None,
        "year": _int((one("citation_publication_date", "citation_date", "citation_year", "dc.date", "dcterms.date") or str(ld.get("datePublished") or ""))[:10]), "journal": one("citation_journal_title"), "volume": one("citation_volume"), "issue": one("citation_issue"),
        "pages": "-".join(filter(None, (first, last))) or None, "doi": bare_doi(one("citation_doi", "dc.identifier", "dcterms.identifier") or str(ld.get("identifier") or "") or source_url), "issn": one("citation_issn"), "isbn": one("citation_isbn"), "publisher": one("citation_publisher", "dc.publisher"),
        "pmid": one("citation_pmid"), "abstract": one("citation_abstract", "dc.description", "description", "og:description"), "oa_url": one("citation_pdf_url"), "language": one("citation_language", "dc.language"), "arxiv_id": arxiv[1] if arxiv else None, "url": one("og:url") or source_url,
    }]


# ---- free text --------------------------------------------------------------------------------------------------------


def split_input(text: str) -> list[str]:
    """Items of pasted text: blank lines, else lines or semicolons, else commas if every part is an identifier."""
    text = text.strip()
    parts = [p for p in re.split(r"\n\s*\n", text) if p.strip()] if re.search(r"\n\s*\n", text) else [text]
    out: list[str] = []
    for p in parts:
        pieces = [x for x in re.split(r"[\n;]", p) if x.strip()]
        for x in pieces:
            by_comma = [c.strip() for c in x.split(",") if c.strip()]
            ids = len(by_comma) > 1 and all(re.match(r"(?i)^(?:doi:\s*)?10\.\d{4,}/\S+$|^(?:arxiv:)?\d{4}\.\d{4,5}(?:v\d+)?$|^(?:pmid:?\s*)\d{6,9}$|^pmc\d+$|^https?://\S+$", c) for c in by_comma)
            out += by_comma if ids else [x.strip()]
    return out


# ---- Spark side -------------------------------------------------------------------------------------------------------

#: Format name -> splitter. Add an entry to read another format.
FORMATS: dict[str, Callable[[str], list[dict]]] = {"bibtex": parse_bibtex, "ris": parse_ris, "json": parse_json, "markdown": parse_markdown, "bookmarks": parse_bookmarks, "html": parse_html, "answer": salvage_json}


def parse_texts(texts: DataFrame, fmt: str, column: str = "value") -> DataFrame:
    """Records of a column of whole texts, as full rows of the record schema. Null texts give none."""
    split = FORMATS[fmt]

    def run(pdfs):
        for pdf in pdfs:
            rows = [{k: r.get(k) for k in _RAW} for t in pdf[column] if isinstance(t, str) for r in split(t)]
            out = pd.DataFrame(rows, columns=_RAW)
            for c in ("year", "month", "num_pages", "citation_count"):
                out[c] = out[c].astype("Int32")
            out["open_access"] = out["open_access"].astype("boolean")
            yield out

    return as_refs(texts.select(F.col(column).cast("string").alias(column)).mapInPandas(run, RAW))


def read_files(spark: SparkSession, paths: str | list[str], fmt: str) -> DataFrame:
    """Records of whole files."""
    return parse_texts(spark.read.text(paths, wholetext=True), fmt)


def read_input(texts: DataFrame, column: str = "value") -> DataFrame:
    """Seeds of pasted text: one record an item, the detected identifier or the title filled in."""
    from codexlake.functions.scalar import detect_item

    @F.pandas_udf("array<string>")
    def items(x: pd.Series) -> pd.Series:
        return x.map(lambda t: split_input(t) if isinstance(t, str) else [])

    d = texts.select(F.explode(items(column)).alias("item")).select(detect_item(F.col("item")).alias("d")).filter("d.value <> ''")
    of = lambda k: F.when(F.col("d.kind") == k, F.col("d.value"))
    return as_refs(d.select(of("doi").alias("doi"), of("arxiv").alias("arxiv_id"), of("pmid").alias("pmid"), of("pmcid").alias("pmcid"), of("isbn").alias("isbn"), of("url").alias("url"), of("title").alias("title")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of retrieval questions; lines that start with # are comments."""
    lines = spark.read.text(path).filter("trim(value) <> '' AND NOT trim(value) LIKE '#%'")
    return lines.select(F.from_json("value", "q string, project string, expect array<struct<doi:string,arxiv:string,title:string>>").alias("r")).select("r.*")


def abstract_from_positions(inv: Column) -> Column:
    """Text of an inverted index {word: [positions]}."""
    pairs = F.flatten(F.transform(F.map_entries(inv), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


# ---- provider payloads: (schema, projection) ----------------------------------------------------------------------------


def _people(c: Column, family, given=None, orcid=None) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(c, lambda a: F.struct(family(a).alias("family"), (given(a) if given else none).alias("given"), (orcid(a) if orcid else none).alias("orcid"), none.alias("affiliation")))


def _crossref(r: Column) -> dict[str, Column]:
    parts = F.get(r["issued"]["date-parts"], F.lit(0))
    return {
        "doi": F.lower(r["DOI"]), "title": F.get(r["title"], F.lit(0)), "authors": _people(r["author"], lambda a: a["family"], lambda a: a["given"], lambda a: a["ORCID"]), "year": F.get(parts, F.lit(0)), "month": F.get(parts, F.lit(1)),
        "journal": F.get(r["container-title"], F.lit(0)), "volume": r["volume"], "issue": r["issue"], "pages": r["page"], "publisher": r["publisher"], "issn": F.get(r["ISSN"], F.lit(0)), "isbn": F.get(r["ISBN"], F.lit(0)), "abstract": F.regexp_replace(r["abstract"], "<[^>]+>", ""),
        "url": r["URL"], "citation_count": r["is-referenced-by-count"], "ref_type": lookup(TYPE_OF_CROSSREF, r["type"], "unknown"), "keywords": r["subject"], "language": r["language"],
    }


def _openalex(r: Column) -> dict[str, Column]:
    return {
        "doi": F.lower(F.regexp_replace(r["doi"], "^https?://doi.org/", "")), "title": r["title"], "year": r["publication_year"], "citation_count": r["cited_by_count"], "open_access": r["open_access"]["is_oa"], "oa_url": r["open_access"]["oa_url"],
        "authors": _people(r["authorships"], lambda a: F.regexp_extract(a["author"]["display_name"], r"(\S+)$", 1), lambda a: F.trim(F.regexp_replace(a["author"]["display_name"], r"\S+$", "")), lambda a: F.regexp_replace(a["author"]["orcid"], "^https?://orcid.org/", "")),
        "journal": r["primary_location"]["source"]["display_name"], "abstract": abstract_from_positions(r["abstract_inverted_index"]), "language": r["language"], "volume": r["biblio"]["volume"], "issue": r["biblio"]["issue"],
        "pages": F.concat_ws("-", r["biblio"]["first_page"], r["biblio"]["last_page"]), "ref_type": lookup(TYPE_OF_OPENALEX | {"article": "journal-article"}, r["type"], "unknown"),
    }


def _semantic_scholar(r: Column) -> dict[str, Column]:
    return {
        "doi": F.lower(r["externalIds"]["DOI"]), "arxiv_id": r["externalIds"]["ArXiv"], "pmid": r["externalIds"]["PubMed"], "title": r["title"], "abstract": r["abstract"], "year": r["year"], "journal": F.coalesce(r["journal"]["name"], r["venue"]), "volume": r["journal"]["volume"],
        "pages": r["journal"]["pages"], "citation_count": r["citationCount"], "oa_url": r["openAccessPdf"]["url"], "open_access": r["isOpenAccess"], "authors": _people(r["authors"], lambda a: F.regexp_extract(a["name"], r"(\S+)$", 1), lambda a: F.trim(F.regexp_replace(a["name"], r"\S+$", ""))),
    }


def _dblp(r: Column) -> dict[str, Column]:
    return {"title": F.regexp_replace(r["title"], r"\.$", ""), "year": r["year"].cast("int"), "journal": r["venue"], "volume": r["volume"], "pages": r["pages"], "doi": F.lower(r["doi"]), "url": r["ee"], "authors": _people(r["authors"]["author"], lambda a: F.regexp_extract(a["text"], r"(\S+?)(?: \d{4})?$", 1), lambda a: F.trim(F.regexp_replace(a["text"], r"\S+(?: \d{4})?$", "")))}


def _google_books(r: Column) -> dict[str, Column]:
    v = r["volumeInfo"]
    isbn = F.get(F.transform(F.filter(v["industryIdentifiers"], lambda i: i["type"] == "ISBN_13"), lambda i: i["identifier"]), F.lit(0))
    return {"title": F.concat_ws(": ", v["title"], v["subtitle"]), "authors": _people(v["authors"], lambda a: F.regexp_extract(a, r"(\S+)$", 1), lambda a: F.trim(F.regexp_replace(a, r"\S+$", ""))), "year": F.try_to_number(F.substring(v["publishedDate"], 1, 4), F.lit("9999")).cast("int"), "publisher": v["publisher"], "isbn": isbn, "num_pages": v["pageCount"], "language": v["language"], "abstract": v["description"], "ref_type": F.lit("book")}


def _openlibrary(r: Column) -> dict[str, Column]:
    return {"title": r["title"], "authors": _people(r["authors"], lambda a: F.regexp_extract(a["name"], r"(\S+)$", 1), lambda a: F.trim(F.regexp_replace(a["name"], r"\S+$", ""))), "year": F.try_to_number(F.regexp_extract(r["publish_date"], r"(\d{4})", 1), F.lit("9999")).cast("int"), "publisher": F.get(r["publishers"], F.lit(0))["name"], "num_pages": r["number_of_pages"], "url": r["url"], "ref_type": F.lit("book")}


def _unpaywall(r: Column) -> dict[str, Column]:
    return {"doi": F.lower(r["doi"]), "title": r["title"], "year": r["year"], "open_access": r["is_oa"], "oa_url": F.coalesce(r["best_oa_location"]["url_for_pdf"], r["best_oa_location"]["url"]), "license": r["best_oa_location"]["license"], "journal": r["journal_name"], "publisher": r["publisher"]}


def _base(r: Column) -> dict[str, Column]:
    name = lambda a: F.trim(F.split_part(a, F.lit(","), F.lit(1)))
    return {
        "title": r["dctitle"], "doi": F.lower(F.get(r["dcdoi"], F.lit(0))), "year": F.try_to_number(F.substring(r["dcyear"], 1, 4), F.lit("9999")).cast("int"), "authors": _people(r["dccreator"], name, lambda a: F.trim(F.regexp_replace(a, r"^[^,]*,?", ""))),
        "publisher": F.get(r["dcpublisher"], F.lit(0)), "abstract": r["dcdescription"], "url": r["dclink"], "open_access": r["dcoa"] == "1", "ref_type": lookup(TYPE_OF_BASE, F.get(r["dctypenorm"], F.lit(0)), "unknown"), "keywords": r["dcsubject"],
    }


_AUTHOR = "array<struct<family:string,given:string,ORCID:string>>"
PROVIDERS: dict[str, tuple[str, Callable[[Column], dict[str, Column]], float]] = {
    "crossref": (f"DOI string, title array<string>, author {_AUTHOR}, issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>, volume string, issue string, page string, publisher string, ISSN array<string>, ISBN array<string>, abstract string, URL string, `is-referenced-by-count` int, type string, subject array<string>, language string", _crossref, 1.0),
    "openalex": ("doi string, title string, publication_year int, cited_by_count int, open_access struct<is_oa:boolean,oa_url:string>, authorships array<struct<author:struct<display_name:string,orcid:string>>>, primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>, language string, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, type string", _openalex, 0.95),
    "semantic_scholar": ("externalIds struct<DOI:string,ArXiv:string,PubMed:string>, title string, abstract string, year int, journal struct<name:string,volume:string,pages:string>, venue string, citationCount int, openAccessPdf struct<url:string>, isOpenAccess boolean, authors array<struct<name:string>>", _semantic_scholar, 0.9),
    "dblp": ("title string, year string, venue string, volume string, pages string, doi string, ee string, authors struct<author:array<struct<text:string>>>", _dblp, 0.85),
    "google_books": ("volumeInfo struct<title:string,subtitle:string,authors:array<string>,publishedDate:string,publisher:string,industryIdentifiers:array<struct<type:string,identifier:string>>,pageCount:int,language:string,description:string>", _google_books, 0.8),
    "openlibrary": ("title string, authors array<struct<name:string>>, publish_date string, publishers array<struct<name:string>>, number_of_pages int, url string", _openlibrary, 0.8),
    "base": ("dctitle string, dccreator array<string>, dcyear string, dcdoi array<string>, dctypenorm array<string>, dclink string, dcdescription string, dcpublisher array<string>, dcoa string, dcsubject array<string>", _base, 0.7),
    "unpaywall": ("doi string, title string, year int, is_oa boolean, best_oa_location struct<url_for_pdf:string,url:string,license:string>, journal_name string, publisher string", _unpaywall, 0.9),
}


def parse_payloads(payloads: DataFrame, provider: str, column: str = "payload") -> DataFrame:
    """Records of a provider's JSON answers; malformed answers are dropped, the provider is noted in sources."""
    schema, project, score = PROVIDERS[provider]
    r = payloads.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).filter({"google_books": "r.volumeInfo IS NOT NULL", "base": "r.dctitle IS NOT NULL"}.get(provider, "r.title IS NOT NULL"))
    out = r.select([c.alias(n) for n, c in project(F.col("r")).items()])
    return as_refs(out).withColumn("sources", F.create_map(F.lit(provider), F.lit(score)))


def parse_arxiv(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Records of arXiv's Atom entries (one entry a row)."""
    x = lambda p: F.xpath_string(F.regexp_replace(column, r"\s(?:xmlns(?::\w+)?)=\"[^\"]*\"|(?<=</?)\w+:", ""), F.lit(p))
    names = F.xpath(F.regexp_replace(column, r"\s(?:xmlns(?::\w+)?)=\"[^\"]*\"", ""), F.lit("entry/author/name/text()"))
    d = payloads.select(F.regexp_extract(x("entry/id"), r"abs/([^v\s]+)", 1).alias("arxiv_id"), F.regexp_replace(x("entry/title"), r"\s+", " ").alias("title"), F.trim(x("entry/summary")).alias("abstract"), F.try_to_number(F.substring(x("entry/published"), 1, 4), F.lit("9999")).cast("int").alias("year"), _people(names, lambda a: F.regexp_extract(a, r"(\S+)$", 1), lambda a: F.trim(F.regexp_replace(a, r"\S+$", ""))).alias("authors"), F.lit("preprint").alias("ref_type"))
    return as_refs(d).withColumn("sources", F.create_map(F.lit("arxiv"), F.lit(0.9)))


def parse_pubmed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Records of PubMed's article XML (one PubmedArticle a row)."""
    a = "PubmedArticle/MedlineCitation/"
    x = lambda p: F.nullif(F.xpath_string(column, F.lit(p)), F.lit(""))
    many = lambda p: F.xpath(F.col(column), F.lit(p))
    people = F.zip_with(many(f"{a}Article/AuthorList/Author/LastName/text()"), many(f"{a}Article/AuthorList/Author/ForeName/text()"), lambda f, g: F.struct(f.alias("family"), g.alias("given"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("affiliation")))
    d = payloads.select(x(f"{a}PMID").alias("pmid"), x(f"{a}Article/ArticleTitle").alias("title"), F.array_join(many(f"{a}Article/Abstract/AbstractText/text()"), " ").alias("abstract"), x(f"{a}Article/Journal/Title").alias("journal"), x(f"{a}Article/Journal/JournalIssue/Volume").alias("volume"), x(f"{a}Article/Journal/JournalIssue/Issue").alias("issue"), x(f"{a}Article/Pagination/MedlinePgn").alias("pages"), F.try_to_number(x(f"{a}Article/Journal/JournalIssue/PubDate/Year"), F.lit("9999")).cast("int").alias("year"), F.lower(x("PubmedArticle/PubmedData/ArticleIdList/ArticleId[@IdType='doi']")).alias("doi"), people.alias("authors"), F.lit("journal-article").alias("ref_type"))
    return as_refs(d).withColumn("sources", F.create_map(F.lit("pubmed"), F.lit(0.95)))


def lookup_cascade(refs: DataFrame, provider: DataFrame) -> DataFrame:
    """refs with `match_id`, `match_by`, `confidence` in a provider's records (which have ids): DOI, PMID, arXiv, ISBN, title."""
    from codexlake.operators.relational import cascade_lookup

    keys = [(k, F.lower(F.col(k)), F.lower(F.col(k))) for k in ("doi", "pmid", "arxiv_id", "isbn")] + [("title", F.lower(F.trim("title")), F.lower(F.trim("title")))]
    trust = {"doi": 1.0, "pmid": 0.95, "arxiv_id": 0.9, "isbn": 0.9, "title": 0.7}
    out = cascade_lookup(refs, provider, keys)
    return out.withColumn("confidence", F.try_element_at(F.create_map(*[F.lit(x) for kv in trust.items() for x in kv]), F.col("match_by")))
