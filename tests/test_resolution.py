import datetime as dt

from pyspark.sql import functions as F

from codexlake.functions.model import PERSON, as_refs
from codexlake.operators import aggregates, dedup, fusion, graph, relational, search, tagging, windows

T0 = dt.datetime(2020, 1, 1)


def library(spark, rows):
    cols = "id string, doi string, isbn string, title string, year int, ref_type string, completeness double, created_at timestamp, abstract string, citation_count int, open_access boolean, authors array<struct<family:string,given:string,orcid:string,affiliation:string>>"
    base = {"doi": None, "isbn": None, "title": None, "year": None, "ref_type": "unknown", "completeness": 0.1, "created_at": T0, "abstract": None, "citation_count": None, "open_access": None, "authors": None}
    names = [c.split()[0] for c in cols.split(", ")]
    return as_refs(spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], cols))


def test_survivors_and_vetoes(spark):
    refs = library(spark, [
        {"id": "a", "doi": "10.1/X", "title": "The study of tides", "completeness": 0.9}, {"id": "b", "doi": "10.1/x", "title": "The study of tides", "abstract": "long text"},
        {"id": "c", "doi": "10.1/y", "title": "Bread"}, {"id": "d", "doi": "10.1/y", "title": "Quantum chromodynamics of the vacuum"},
        {"id": "e", "isbn": "1", "title": "A book", "ref_type": "book"}, {"id": "f", "isbn": "1", "title": "A book", "ref_type": "book-chapter"},
    ])
    pairs = dedup.identifier_pairs(refs, "doi")
    assert {(r.keep_id, r.drop_id) for r in pairs.collect()} == {("a", "b"), ("c", "d")}
    good = dedup.veto_titles(pairs, refs, strict=False)
    assert [(r.keep_id, r.drop_id) for r in good.collect()] == [("a", "b")]
    assert dedup.veto_titles(dedup.identifier_pairs(refs, "isbn"), refs, strict=True).count() == 0
    bridge = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2)], "ref_id string, tag int")
    live, gone, moved = dedup.apply_pairs(refs, good, ["abstract", "title"], {"tags": (bridge, "ref_id")})
    kept = {r.id: r for r in live.collect()}
    assert set(kept) == {"a", "c", "d", "e", "f"} and kept["a"].abstract == "long text" and gone.first().merged_into == "a"
    assert sorted((r.ref_id, r.tag) for r in moved["tags"].collect()) == [("a", 1), ("a", 2)]


def test_dedup_is_idempotent(spark):
    refs = library(spark, [{"id": str(i), "doi": f"10.1/{i % 3}", "title": "Same title here"} for i in range(9)])
    live, gone = dedup.dedup_all(refs, ["abstract"])
    assert live.count() == 3 and gone.count() == 6
    again, nothing = dedup.dedup_all(live, ["abstract"])
    assert again.count() == 3 and nothing.count() == 0


def test_conflicts_and_collisions(spark):
    refs = library(spark, [{"id": "a", "doi": "10.1/1", "isbn": "5", "title": "Deep sea corals of the north", "year": 2000}, {"id": "b", "doi": "10.1/2", "isbn": "5", "title": "Deep sea corals of the north", "year": 2001}, {"id": "c", "title": "Deep sea corals of the north", "year": 2009}])
    p = spark.createDataFrame([("a", "b")], "keep_id string, drop_id string")
    assert dedup.veto_conflicts(p, refs, "isbn").count() == 0
    col = spark.createDataFrame([("b", "a"), ("c", "a")], "id string, other string")
    assert [(r.keep_id, r.drop_id) for r in dedup.collision_merges(col, refs).collect()] == [("a", "b")]
    fuzzy = dedup.fuzzy_title_pairs(refs).collect()
    assert {(r.id_a, r.id_b) for r in fuzzy} == {("a", "b"), ("a", "c"), ("b", "c")} and fuzzy[0].label == "likely"
    assert dedup.duplicate_report(refs).filter("rule = 'isbn'").first().n == 2


def test_fuzzy_titles_of_large_blocks(spark, sf):
    """One first word in 450 titles, more than a block once held, against all pairs."""
    import random

    from codexlake.functions import text as T
    from codexlake.plans.carriers import fuzzy_titles

    r = random.Random(2)
    titles = ["the " + " ".join(r.choice(["tide", "wave", "reef", "kelp", "moon", "sand"]) + str(r.randrange(3)) for _ in range(r.randrange(2, 9))) for _ in range(430)]
    titles += [t[: r.randrange(12, len(t))] + "x" for t in titles[:20] if len(t) > 12]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    want = {(a, b): T.token_sort_ratio(titles[a], titles[b]) for b in range(len(titles)) for a in range(b) if abs(len(titles[a]) - len(titles[b])) <= 0.4 * max(len(titles[a]), len(titles[b]))}
    got = [(r.id_a, r.id_b, r.score) for r in dedup.fuzzy_title_pairs(df).collect()]
    assert len(got) > 100 and sorted(got) == sorted((*k, v) for k, v in want.items() if v >= 90)
    lines = {x.doc_id: x.text.split("\n")[0] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i for x in fuzzy_titles(spark, sf).collect() for i in (x.id_a, x.id_b)}
    print(len(held), sum(not 25 <= len(lines[i]) <= 400 for i in held))
    copies = {}
    for i, t in lines.items():
        words = T.ascii_title(t)
        if len(t) > 10 and len(words) >= 10 and len(words.split()[0]) >= 3:
            copies.setdefault(words, []).append(i)
    assert {i for ids in copies.values() if len(ids) > 1 for i in ids} <= held


def test_fusion(spark):
    person = lambda f, g, o=None: (f, g, o, None)
    rows = [
        ("s", 0, 0.2, True, "Waves in shallow water", 1999, [person("Doe", "J.")], ["Sea", "tide"], None, {}, None),
        ("s", 1, 0.9, False, "Waves in shallow water.", 2000, [person("Doe", "Jane", "0000"), person("Roe", "R")], ["sea", "wave"], "abstract", {"crossref": 0.9}, 5),
        ("s", 2, 0.99, False, "Completely different matter", 1800, None, None, "much longer abstract", {"dblp": 0.5}, 99),
    ]
    df = spark.createDataFrame(rows, f"seed_id string, pos int, confidence double, is_seed boolean, title string, year int, authors array<{PERSON}>, keywords array<string>, abstract string, sources map<string,double>, citation_count int")
    rest = as_refs(df).columns
    full = df
    for c, t in as_refs(df).dtypes:
        if c in rest and c not in df.columns and c != "id":
            full = full.withColumn(c, F.lit(None).cast(t))
    r = fusion.fuse(full).first()
    assert r.year == 2000 and r.citation_count == 5 and r.abstract == "abstract" and r.keywords == ["Sea", "tide", "wave"] and r.sources == {"crossref": 0.9}
    assert [(p.family, p.given, p.orcid) for p in r.authors] == [("Doe", "Jane", "0000"), ("Roe", "R", None)]


def test_merge_people():
    a = [{"family": "Doe", "given": "J", "orcid": None, "affiliation": None}]
    b = [{"family": "Doe", "given": "Jane", "orcid": "1", "affiliation": "U"}, {"family": "Li", "given": None, "orcid": None, "affiliation": None}]
    assert fusion.merge_people([a, b], [0.9, 0.5])[0]["given"] == "Jane" and len(fusion.merge_people([a, b], [0.9, 0.5])) == 2
    assert fusion.merge_people([[], []], [1, 1]) == []


def test_upserts(spark):
    base = spark.createDataFrame([("1", "10.1/a", "old", 1), ("2", None, "x", 1)], "id string, doi string, title string, created_at int")
    batch = spark.createDataFrame([("9", "10.1/a", "new", 7, 1), ("2", None, "y", 7, 2), ("2", None, "z", 7, 3), ("3", "10.1/b", "n", 7, 4), ("4", "10.1/b", "m", 7, 5)], "id string, doi string, title string, created_at int, batch_seq int")
    got = {r.id: (r.title, r.created_at) for r in relational.upsert(base, batch).collect()}
    assert got == {"1": ("new", 1), "2": ("z", 1), "3": ("m", 7)}
    fresh, hits = relational.replace_unless_taken(base, spark.createDataFrame([("2", "10.1/a", "t", 1)], base.schema))
    assert fresh.first().doi is None and hits.first().other == "1"
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {r[0] for r in relational.rename_label(names, "a", "c").collect()} == {"b", "c"} and {r[0] for r in relational.rename_label(names, "a", "b").collect()} == {"a", "b"}
    files = spark.createDataFrame([("/x/A.pdf", 1, 1), ("/y/b.pdf", 2, 2)], "path string, size int, mtime int")
    paths = relational.repair_paths(spark.createDataFrame([("1", "/x/A.pdf"), ("2", "/old/B.PDF"), ("3", "/gone.pdf")], "id string, pdf_path string"), files)
    assert {r.id: r.outcome for r in paths.collect()} == {"1": "kept", "2": "moved", "3": "stale"}
    assert relational.new_or_changed(files, files.limit(1)).count() == 1
    assert [r.name for r in relational.in_given_order(names, "name", ["b", "zz", "a"]).collect()] == ["b", "a"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "salt and water"), (2, "saltwater fish"), (3, "fish"), (4, None)], "id long, text string")
    index = search.build_index(docs, "id", "text")
    assert {r.doc for r in search.search_all_prefixes(index, ["salt"]).collect()} == {1, 2}
    assert {r.doc for r in search.search_all_prefixes(index, ["salt", "fi"]).collect()} == {2}
    changed = spark.createDataFrame([(3, "salt")], "id long, text string")
    again = search.patch_index(index, changed.select("id"), docs.filter("id <> 3").unionByName(changed), "id", "text")
    assert {r.doc for r in search.search_all_prefixes(again, ["fish"]).collect()} == {2}
    assert again.lengths.count() == 4 and search.query_terms("A deep-sea the the") == ["deep-sea", "the"]
    assert search.fallback(docs, "%", ["text"]).count() == 0


def test_graph_and_notes(spark):
    refs = spark.createDataFrame([("r1", "An abstract with  Words")], "id string, abstract string")
    passages = spark.createDataFrame([("r1", 1, "Verbatim TEXT of the page")], "ref_id string, chunk_id long, text string")
    notes = spark.createDataFrame([(1, "r1", 1, "verbatim text"), (2, "r9", 1, "x"), (3, "r1", 1, "absent"), (4, "r1", None, "with words"), (5, "r1", None, None)], "note_id long, ref_id string, chunk_id long, quote string")
    got = {r.note_id: r.reason for r in graph.split_notes(notes, refs, passages).collect()}
    assert got == {1: None, 2: "unknown reference", 3: "quote not found", 4: None, 5: None}
    status = graph.lookup_status(spark.createDataFrame([("a", "10.1/x"), ("b", None), ("c", "10.1/z")], "ref_id string, doi string"), spark.createDataFrame([("a", None)], "ref_id string, error string"))
    assert {r.ref_id: r.status for r in status.collect()} == {"a": "ok", "b": "no_doi", "c": "not_found"}


def test_tags_and_windows(spark):
    refs = library(spark, [{"id": "a", "title": "Tides and waves", "year": 2020, "ref_type": "journal-article", "open_access": True, "completeness": 0.95}, {"id": "b", "title": "Other", "completeness": 0.2}])
    rule = tagging.TagRule(tags=["Ocean"], keywords=["TIDES"], year_from=2000)
    got = {r.id: r.tags for r in tagging.auto_tags(refs, [rule]).collect()}
    assert got == {"a": ["journal-article", "open-access", "2020", "complete", "ocean"], "b": ["incomplete"]}
    assert tagging.suggest_tags(refs, spark.createDataFrame([("Waves",), ("none",)], "name string"), F.col("title")).collect()[0].tag == "waves"
    files = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 200000)], "path string, size int, mtime int")
    assert {r.path for r in windows.evict_oldest(files, 6).collect()} == {"a", "b"}
    q = spark.createDataFrame([("k", 1.0, 2, 3, 1, None, 0.5, "done"), ("k", 3.0, 1, 0, 4, None, 0.2, "pending")], "into string, priority double, difficulty int, strategy_level int, attempts int, last_attempt timestamp, completeness_before double, status string")
    r = aggregates.queue_rollup(q, "into").first()
    assert (r.priority, r.difficulty, r.attempts, r.status) == (3.0, 1, 4, "pending")


def test_fuzzy_titles_of_many_copies(spark):
    """Copies are a row each, not all pairs; classes and their pairs say what all pairs say, also over chunks and long titles."""
    import random

    from codexlake.functions import text as T

    r = random.Random(3)
    word = lambda: "".join(r.choice("aeihnrst") for _ in range(r.randrange(2, 9)))
    titles = ["and " + " ".join(word() for _ in range(r.randrange(3, 40))) for _ in range(60)]
    for t in titles[:60]:
        words = t.split()
        titles += [" ".join([words[0], *r.sample(words[1:], len(words) - 1)]), t[: 9 * len(t) // 10], t + " " + word()]
    titles += [titles[0]] * 40 + [titles[7].upper()] * 20
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    plain = [T.ascii_title(t) for t in titles]
    want = {(a, b): v for b in range(len(titles)) for a in range(b) for v in [T.token_sort_ratio(plain[a], plain[b])] if v >= 90 and abs(len(plain[a]) - len(plain[b])) <= 0.4 * max(len(plain[a]), len(plain[b]))}
    pairs = [((x.id_a, x.id_b), x.score) for x in dedup.fuzzy_title_pairs(df, largest=50).collect()]
    assert len(pairs) > 1000 and sorted(pairs) == sorted(want.items())
    rows = dedup.fuzzy_title_classes(df, largest=50).collect()
    first = {x.id_b: x.id_a for x in rows if x.same_words}
    near = {(x.id_a, x.id_b): x.score for x in rows if not x.same_words}
    assert len(first) + len(near) == len(rows) < 400 and not {i for p in near for i in p} & first.keys()
    top = lambda i: first.get(i, i)
    found = {}
    for b in range(len(titles)):
        for a in range(b):
            score = 100.0 if top(a) == top(b) else near.get((min(top(a), top(b)), max(top(a), top(b))))
            if score is not None:
                found[a, b] = score
    assert found == want


def test_ratios_of_batches_are_those_of_pairs():
    import random

    import numpy as np

    from codexlake.functions import text as T

    r = random.Random(4)
    words = []
    for n in (1, 9, 62, 63, 64, 65, 127, 128, 200, 700):
        for _ in range(3):
            a = [r.choice("abcdef 012") for _ in range(n)]
            words += ["".join(a), *["".join(c if r.random() > f else r.choice("abz") for c in a) for f in (0.03, 0.08, 0.12, 0.2)]]
    pairs = np.array([(a, b) if len(words[a]) <= len(words[b]) else (b, a) for b in range(len(words)) for a in range(b)])
    for least in (60, 90):
        x, y, ratio = T.indel_ratios(words, pairs, least)
        want = [(a, b, v) for a, b in pairs.tolist() for v in [T.indel_ratio(words[a], words[b])] if v >= least]
        assert sorted(zip(x.tolist(), y.tolist(), ratio.tolist())) == sorted(want) and len(want) > 50
