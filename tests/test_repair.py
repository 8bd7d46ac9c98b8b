import random

from pyspark.sql import functions as F

from codexlake.functions import repair
from codexlake.operators import aggregates, backfill, relational, resolution, search
from codexlake.operators.resolution import FEATURES, Work, features, judge


def one(spark, c, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.select("i", c(F.col("s")).alias("v")).orderBy("i").select("v").collect()]


def test_bare_title():
    assert repair.bare_title("(Paperback) Élan vital: the full story (2nd ed.)") == "Elan vital the full story"
    assert repair.bare_title("The history of the sea | A publisher") == "The history of the sea"
    assert repair.bare_title("Short: x") == "Short: x" and repair.bare_title("") == "" and repair.bare_title(None) is None
    assert repair.bare_title("“Quoted words of note”") == "Quoted words of note"


def test_understand(spark):
    got = one(spark, repair.understand, "LNCS 1838", "lnai vol. 12: Agents at work", "Lecture Notes in Mathematics 77 - Rings", "$\\mathbf{Q}$ and Classif ication", None, "", "[Lecture notes] LNM 5 Groups")
    assert [tuple(g) for g in got] == [
        ("", "Lecture Notes in Computer Science", "1838"), ("Agents at work", "Lecture Notes in Artificial Intelligence", "12"), ("Rings", "Lecture Notes in Mathematics", "77"),
        ("Q and Classification", None, None), ("", None, None), ("", None, None), ("Lecture notes LNM 5 Groups", None, None),
    ]
    known = {"sufficient"}
    assert one(spark, lambda c: repair.join_ligatures(c, known), "suf ficient rays of light", None) == ["sufficient rays of light", None]
    assert one(spark, repair.expand_journal, "J.S.L.", "Nature", None) == ["Journal of Symbolic Logic", "Nature", ""]


def test_file_names(spark):
    assert one(spark, repair.readable, "teoremaBell_AJP1978.pdf", "100% sure%20thing", "a+b%zz", None, "z-lib org Deep seas.djvu") == ["teorema Bell AJP 1978", "100% sure thing", "a+b%zz", "", "Deep seas"]
    assert [tuple(h) for h in one(spark, repair.folder_hints, "/x/Acta 1955/vol 1961/a.pdf", "C:\\Annals of Tides\\b.pdf", "a.pdf", None)] == [(1961, "Acta 1955"), (None, "Annals of Tides"), (None, None), (None, None)]


def test_parse_note(spark):
    got = one(spark, repair.parse_note, "A title / Bell, Ann; Bo Reed and Cy / 1999", "Only a title", "T | 2001 | X & Y", "", None)
    plain = [(g.title, g.year, None if g.authors is None else [(a.family, a.given) for a in g.authors]) for g in got]
    assert plain == [("A title", 1999, [("Bell", "Ann"), ("Reed", "Bo"), ("Cy", None)]), ("Only a title", None, None), ("T", 2001, [("X", None), ("Y", None)]), (None, None, None), (None, None, None)]


def test_features_by_hand():
    x = dict(zip(FEATURES, features(Work("Arrow Logic and", ["J. Kempner"], 2000), Work("Arrow Logic and Multi-modal Logic", ["Jan Kempner"], 2003))))
    # telling words: arrow logic | arrow logic multi modal logic
    assert x["cov"] == 1 and x["miss_mid"] == 0 and x["rev"] == 3 / 5 and x["lead"] == 0 and x["order"] == 1 and x["tail"] == 3 / 6
    assert x["author_conflict"] == 0 and x["author_unknown"] == 0 and x["ydiff"] == 3 / 5 and x["year_unknown"] == 0 and x["n_kw"] == 2 / 12 and x["short_cand_on_trunc"] == 0
    part = dict(zip(FEATURES, features(Work("Geometric complexity theory V", [], None), Work("Geometric complexity theory", [], None))))
    assert part["num_conflict"] == 1 and part["author_unknown"] == 1 and part["year_unknown"] == 1
    filed = dict(zip(FEATURES, features(Work("Reed 1999 deep sea corals", [], None), Work("Corals of the deep sea", ["A. Reed"], 1999), "Reed", 1999)))
    assert filed["is_filename"] == 1 and filed["cov"] == 1 and filed["order"] == 2 / 3 and filed["lead"] == 1 / 6 and filed["lead_x_filename"] == 1 / 6
    empty = dict(zip(FEATURES, features(Work("", [], None), Work("", [], None))))
    assert empty["cov"] == 0 and empty["tail"] == 1 and all(v == v for v in empty.values())


def test_judge():
    book = Work("History of science as explanation", ["M. Finocchiaro"], 1973, "book")
    assert judge(book, book) == (judge(book, book)[0], False, "accept")
    assert judge(book, book._replace(kind="journal-article"))[1:] == (True, "reject")
    assert judge(book, book._replace(year=1980))[1:] == (True, "reject") and judge(book, book._replace(authors=["X. Other"]))[1:] == (True, "reject")
    assert judge(book, book._replace(title="M. A. Finocchiaro. History of science as explanation"))[0] <= 0.5


def test_judge_pairs_agrees_with_the_function(spark):
    rnd = random.Random(3)
    words = "deep sea corals of the north and review part ii logic arrow light 1999".split()
    work = lambda: (" ".join(rnd.choices(words, k=rnd.randint(0, 7))), rnd.choice([None, [], ["Ann Bell"], ["Bo Reed", None]]), rnd.choice([None, 1200, 1999, 2001]), rnd.choice([None, "book", "article"]))
    rows = [(i, *work(), *work()) for i in range(200)]
    kinds = "title string, {0}_authors array<string>, {0}_year int, {0}_kind string"
    pairs = spark.createDataFrame(rows, "i int, " + ", ".join(f"{s}_" + kinds.format(s) for s in ("seed", "cand")))
    made = lambda t, a, y, k: Work(t, [p for p in a or [] if p], y, k)
    want = {r[0]: judge(made(*r[1:5]), made(*r[5:])) for r in rows}
    assert {r.i: (r.p, r.veto, r.verdict) for r in resolution.judge_pairs(pairs).collect()} == want


def test_books():
    assert resolution.book_title_fits("Black holes", "Black holes and time warps") == "short"
    assert resolution.book_title_fits("Holes", "Holes") is None and resolution.book_title_fits(None, "x") is None
    assert resolution.book_title_fits("The deep sea corals of Norway", "Deep-sea corals of Norway: a guide") == "whole"
    assert resolution.book_title_fits("The deep sea corals of Norway", "Bread and butter") is None


def test_short_book_titles_need_the_year(spark):
    seeds = spark.createDataFrame([(1, "Machine translation", "hutchins", 2006), (2, "Machine translation", "hutchins", None), (3, None, "x", 2000)], "seed_id int, title string, surname string, year int")
    volume = lambda s, pos, first, year: (s, pos, "Machine translation", ["John Hutchins"], first, year, f"978{pos}")
    volumes = spark.createDataFrame([volume(1, 0, 2000, None), volume(1, 1, 2000, 2005), volume(2, 0, 2000, 2000), (3, 0, None, None, None, None, "1")], "seed_id int, pos int, title string, names array<string>, first_year int, year int, isbn string")
    assert [tuple(r) for r in resolution.pick_books(seeds, volumes).collect()] == [(1, 1, "9781")]


def test_reports_of_nothing(spark):
    log = spark.createDataFrame([], "ts timestamp, level string, logger string, message string")
    assert aggregates.session_metrics(log).first().n_lines == 0 and aggregates.resolved_by_provider(log).count() == 0
    assert tuple(aggregates.throughput(log).first()) == (None, None, None, None)
    assert aggregates.run_report({"a": log.select("level"), "b": spark.range(1)}).first().report == '{"b":{"id":0}}'


def test_shuffled_does_not_depend_on_partitions(spark):
    d = spark.range(500)
    a, b = relational.shuffled(d.repartition(7), "id", 50, 1), relational.shuffled(d, "id", 50, 1)
    assert a.collect() == b.collect() != relational.shuffled(d, "id", 50, 2).collect()


def test_notes_search(spark):
    notes = spark.createDataFrame([(1, "p", "active", "Deep sea corals"), (2, "q", "active", "sea salt"), (3, "p", "old", "corals corals"), (4, "p", "active", None)], "id int, project string, status string, claim string")
    ids = lambda **k: [r.id for r in search.search_notes(notes, "corals, sea", **k).collect()]
    assert ids()[0] == 1 and set(ids()) == {1, 2} and ids(project="p") == [1] and set(ids(include_inactive=True)) == {1, 2, 3}


def test_candidates_of_nothing(spark):
    from codexlake.functions.model import as_refs

    none = as_refs(spark.createDataFrame([], "id string"))
    assert backfill.metadata_candidates(none, 5).count() == 0
    assert backfill.file_candidates(none, spark.createDataFrame([], "ref_id string, api string, entry_hash string, result string"), 5).count() == 0
