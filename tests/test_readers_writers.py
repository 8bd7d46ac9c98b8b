import json

from codexlake.functions.model import as_refs
from codexlake.sources import readers, writers

BIB = r"""@article{key1, title = {On the {F}low of {\'E}nergy}, author = {Doe, Jane and Roe, Rick}, year = 2004, journal = "J. Flow", pages = {10--20}, doi = {https://doi.org/10.1000/Flow.1}, month = mar, keywords = {a, b}, volume = {3}}
@misc{k2, title={A preprint}, eprint={2101.00001}, archivePrefix={arXiv}, note={PMID: 1234567}}
@comment{nothing}"""
RIS = """TY  - JOUR\nTI  - Salt\nAU  - Doe, Jane\nAU  - Roe, Rick\nPY  - 1999/05/\nJO  - J Salt\nSP  - 1\nEP  - 9\nDO  - 10.1000/salt\nSN  - 1234-5678\nER  - \nTY  - CONF\nT1  - Tides\nT2  - Sea Meeting\nER  - \n"""


def records(spark, text, fmt):
    return readers.parse_texts(spark.createDataFrame([(text,), (None,)], "value string"), fmt).collect()


def test_bibtex(spark):
    a, b = records(spark, BIB, "bibtex")
    assert a.title == "On the Flow of Énergy" and [p.family for p in a.authors] == ["Doe", "Roe"] and a.year == 2004 and a.month == 3 and a.pages == "10-20" and a.doi == "10.1000/flow.1" and a.keywords == ["a", "b"] and a.ref_type == "journal-article"
    assert b.arxiv_id == "2101.00001" and b.ref_type == "preprint" and b.pmid == "1234567"


def test_ris(spark):
    a, b = records(spark, RIS, "ris")
    assert a.title == "Salt" and a.year == 1999 and a.pages == "1-9" and a.issn == "1234-5678" and a.isbn is None and a.journal == "J Salt"
    assert b.ref_type == "conference-paper" and b.event_name == "Sea Meeting"


def test_json(spark):
    text = json.dumps({"items": [{"type": "article-journal", "title": "T", "author": [{"family": "A", "given": "B"}], "issued": {"date-parts": [[2010, 2]]}, "DOI": "10.1/X"}, {"title": "U", "authors": "C D; E F", "year": "2001", "shelf": 4}]})
    a, b = records(spark, text, "json")
    assert a.year == 2010 and a.authors[0].family == "A"
    assert [p.family for p in b.authors] == ["D", "F"] and json.loads(b.extras) == {"shelf": 4}
    assert records(spark, "{broken", "json") == []
    assert records(spark, 'Sure:\n```json\n{"title": "V"}\n```', "answer")[0].title == "V"


def test_markdown_and_bookmarks_and_tables(spark):
    md = "---\ntitle: \"One\"\ndoi: 10.1000/one\nyear: 1990\n---\nSee 10.1000/one and 10.1000/two, arXiv:2001.00001."
    got = records(spark, md, "markdown")
    assert [r.doi for r in got] == ["10.1000/one", "10.1000/two", None] and got[2].arxiv_id == "2001.00001"
    marks = '<DL><p><DT><H3>Sea</H3><DL><p><DT><A HREF="https://a.example/x">X</A><DT><A HREF="https://a.example/x">again</A></DL><DT><A HREF="https://doi.org/10.1000/z">Z</A></DL>'
    got = records(spark, marks, "bookmarks")
    assert [r.url for r in got] == ["https://a.example/x", "https://doi.org/10.1000/z"] and got[0].keywords == ["Sea"] and got[1].doi == "10.1000/z"
    assert readers.parse_reference_table("| Key | Level |\n|---|---|\n| a | high |\n\ntext") == [{"key": "a", "level": "high"}]


def test_html(spark):
    page = '<html><head><title>Site</title><meta name="citation_title" content="True title"><meta name="citation_author" content="Doe, J."><meta name="citation_publication_date" content="2011/03/01"><meta property="og:title" content="og"><script type="application/ld+json">{"@type": "Article", "headline": "ld"}</script></head></html>'
    r = records(spark, page, "html")[0]
    assert r.title == "True title" and r.year == 2011 and r.authors[0].family == "Doe"
    assert readers.parse_html("<title>Only this</title>", "https://arxiv.org/abs/2001.00001")[0]["arxiv_id"] == "2001.00001"


def test_free_text(spark):
    assert readers.split_input("10.1000/a, 10.1000/b\nA title, with a comma; PMID: 1234567") == ["10.1000/a", "10.1000/b", "A title, with a comma", "PMID: 1234567"]
    got = readers.read_input(spark.createDataFrame([("10.1000/a\n2101.00001\nSome title",), (None,)], "value string")).collect()
    assert {r.doi or r.arxiv_id or r.title for r in got} == {"10.1000/a", "2101.00001", "Some title"}


def test_providers(spark):
    cross = json.dumps({"DOI": "10.1/A", "title": ["T"], "author": [{"family": "F", "given": "G"}], "issued": {"date-parts": [[2012, 4]]}, "type": "journal-article", "is-referenced-by-count": 7})
    alex = json.dumps({"doi": "https://doi.org/10.1/B", "title": "U", "publication_year": 2013, "abstract_inverted_index": {"hello": [0, 2], "world": [1]}, "authorships": [{"author": {"display_name": "Ann Lee"}}], "type": "article", "open_access": {"is_oa": True}})
    a = readers.parse_payloads(spark.createDataFrame([(cross,), ("{bad",)], "payload string"), "crossref").collect()
    b = readers.parse_payloads(spark.createDataFrame([(alex,)], "payload string"), "openalex").first()
    assert len(a) == 1 and a[0].year == 2012 and a[0].citation_count == 7 and a[0].sources == {"crossref": 1.0}
    assert b.abstract == "hello world hello" and b.authors[0].family == "Lee" and b.open_access and b.doi == "10.1/b"
    for provider in readers.PROVIDERS:
        assert readers.parse_payloads(spark.createDataFrame([("{}",)], "payload string"), provider).count() <= 1
    atom = "<entry xmlns='x'><id>http://arxiv.org/abs/2001.00001v2</id><title>On\n this</title><summary>S</summary><published>2020-01-01</published><author><name>Ann Lee</name></author></entry>".replace("'", '"')
    r = readers.parse_arxiv(spark.createDataFrame([(atom,)], "payload string")).first()
    assert r.arxiv_id == "2001.00001" and r.title == "On this" and r.year == 2020 and r.authors[0].family == "Lee"
    med = "<PubmedArticle><MedlineCitation><PMID>77</PMID><Article><ArticleTitle>Cells</ArticleTitle><Journal><Title>J</Title><JournalIssue><Volume>2</Volume><PubDate><Year>2005</Year></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"
    r = readers.parse_pubmed(spark.createDataFrame([(med,)], "payload string")).first()
    assert r.pmid == "77" and r.year == 2005 and r.authors[0].family == "Doe"


def test_round_trips(spark, tmp_path):
    refs = readers.parse_texts(spark.createDataFrame([(BIB,)], "value string"), "bibtex")
    for fmt in ("bibtex", "ris"):
        text = "\n".join(r[0] for r in refs.select(writers.FORMATS[fmt]()).collect())
        again = {r.title: r for r in records(spark, text, fmt)}
        for r in refs.collect():
            back = again[r.title]
            assert back.year == r.year and back.doi == r.doi and back.pages == r.pages and [p.family for p in back.authors or []] == [p.family for p in r.authors or []]
    for fmt in (*writers.FORMATS, "csv"):
        writers.write(refs, str(tmp_path / fmt), fmt)
        assert spark.read.text(str(tmp_path / fmt)).count() >= 2
    rdf = refs.select(writers.zotero_rdf()).first()[0]
    assert "<foaf:surname>Doe</foaf:surname>" in rdf


def test_log_and_questions(spark, tmp_path):
    from codexlake.operators.aggregates import last_session, log_lines

    log = spark.createDataFrame([("2026-01-01 10:00:00,123 INFO app.core: start",), ("2026-01-01 10:01:00 ERROR app.x: bad",), ("2026-01-01 11:00:00 INFO app.core: start",), ("noise",)], "value string")
    rows = log_lines(log)
    assert rows.count() == 3 and last_session(rows, "start").count() == 1
    (tmp_path / "q.jsonl").write_text('# note\n{"q": "what", "expect": [{"doi": "10.1/x"}]}\n\n')
    assert readers.read_questions(spark, str(tmp_path / "q.jsonl")).first().expect[0].doi == "10.1/x"
    assert as_refs(spark.createDataFrame([("a", 1)], "title string, shelf int")).first().extras == '{"shelf":1}'
