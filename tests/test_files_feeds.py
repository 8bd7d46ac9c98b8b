import json

from pyspark.sql import functions as F

from codexlake.functions.model import as_refs
from codexlake.operators import backfill, matching
from codexlake.sources import feed, files


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_text(" ")
    (tmp_path / "c.bin").write_bytes(b"\xff")
    assert {r.size for r in files.listing(spark, str(tmp_path), "*.txt").collect()} == {7, 1}
    got = files.pages(spark, str(tmp_path), lambda b: b.decode().split("\f"), ocr=lambda b: ["seen"]).collect()
    assert {(r.path[-5:], r.page, r.text, r.status) for r in got} == {("a.txt", 1, "one", "ok"), ("a.txt", 2, "two", "ok"), ("b.txt", 1, "seen", "ok"), ("c.bin", 0, None, "error: UnicodeDecodeError")}


def test_file_names():
    a = files.filename_meta("/x/Doe_2004_On%20the%20flow-of_energy.pdf")
    assert (a["author"], a["year"], a["title"]) == ("Doe", 2004, "On the flow of energy")
    assert files.filename_meta("10.1000_abc.5.pdf")["doi"] == "10.1000/abc.5" and files.filename_meta("2101.00001v2.pdf")["arxiv_id"] == "2101.00001"


def test_version_log(spark, tmp_path):
    (tmp_path / "3.jsonl").write_text(json.dumps({"id": "1", "title": "a"}) + "\n" + json.dumps({"id": "2", "title": "b"}))
    (tmp_path / "5.jsonl").write_text(json.dumps({"id": "1", "title": "c"}))
    reader = feed.VersionLog({"path": str(tmp_path)}).simpleStreamReader(None)
    rows, offset = reader.read(reader.initialOffset())
    assert [r[:3] for r in rows] == [("1", "a", 3), ("2", "b", 3), ("1", "c", 5)] and offset == {"version": 5}
    assert list(reader.readBetweenOffsets({"version": 3}, {"version": 5}))[0][1] == "c"


def test_backfill(spark):
    refs = as_refs(spark.createDataFrame([("r1", "10.1/a", None, "Something else"), ("r2", None, "2001.00001", "A long enough title")], "id string, doi string, arxiv_id string, title string"))
    entries = spark.createDataFrame([("10.1/A", None, None, "", "n1"), ("10.48550/arXiv.2001.00001", None, None, "", "n2"), (None, None, "A Long Enough Title!", "MEMORY", "n3"), (None, None, "nothing", "", "n4")], "doi string, arxiv_id string, title string, level string, note string")
    none = spark.createDataFrame([("p", "r1", "n1")], "project string, ref_id string, claim string")
    notes, counts = backfill.backfill_notes(entries, refs, none, "p")
    assert [(r.ref_id, r.claim) for r in notes.collect()] == [("r2", "n2")]
    assert {r.result: r.n for r in counts.collect()} == {"doi": 1, "doi_arxiv": 1, "memory": 1, "unmatched": 1}


def test_saved_search(spark):
    refs = as_refs(spark.createDataFrame([("a", 2000, "Tides", "read"), ("b", 2010, "Waves", None)], "id string, year int, title string, status string"))
    assert [r.id for r in backfill.saved_search(refs, {"year_from": 2005, "status": ["unread"], "query": "wave"}).collect()] == ["b"]
    assert backfill.saved_search(refs, {"has_pdf": True}).count() == 0


def test_pairwise_decisions(spark):
    df = spark.createDataFrame([("The tide of the northern sea", "northern sea tide", 2000, 2002), ("Bread", "Salt", 1990, 1990)], "a string, b string, ya int, yb int")
    none = F.array().cast("array<struct<family:string,given:string>>")
    got = [r[0] for r in df.select(matching.record_fits(F.col("a"), F.col("b"), F.col("ya"), F.col("yb"), none, none)).collect()]
    assert got == [True, False]
    assert matching.hit_score("The northern tide", ["Doe"], None, None, 2001, "The northern tide ...", "Doe 2001") > matching.hit_score("The northern tide", ["Roe"], None, None, 2001, "A cook book", "") + 0.5
    t = spark.createDataFrame([("A short title", "A short title: with more"), ("A longer title here", "Other words"), (None, "New")], "s string, f string")
    assert [r[0] for r in t.select(matching.better_title(F.col("s"), F.col("f"))).collect()] == ["A short title: with more", "A longer title here", "New"]
    w = spark.createDataFrame([("one two three four five six seven eight nine", "zero one two three four five six seven eight x"), ("a b", "c d")], "a string, t string")
    assert [r[0] for r in w.select(matching.wording_hit(F.col("a"), F.col("t"))).collect()] == [True, False]
