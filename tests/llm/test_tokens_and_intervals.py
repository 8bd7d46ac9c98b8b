"""Byte-level BPE, token alignment and the interval join against the libraries and plain loops; repaired edge cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codexlake.llm import align, ann, byte_bpe, html_extract, intervals, language_id, near_dedup, quality_model, secrets, sentencepiece_bpe
from codexlake.llm import queries as Q
from codexlake.llm.common import table

POOLS = (
    "ab cd,.!?'s're 0123456789\n\t  ", "".join(map(chr, range(0x20, 0x3000))), "".join(map(chr, range(0x10000, 0x1FFFF))),
    "՘꟒\U0001e6c0\U00012480 a1\U00012550 x", "aaaaaaab", "\x1c\x1d\x85\xa0   x▁<|endoftext|>",
)
HARD = [None, "", " ", "\n", "  \n\n  a", "<|endoftext|>", "x▁y", "a" * 3000, "中" * 500, "it's 'll 12 34", "é", "\U0001f600" * 7, " \t\x0b\x00z"]


def made(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(POOLS) if k % 3 else POOLS[k % 6]) for _ in range(rng.randrange(60))) for k in range(n)]


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})


def test_perfect_hash():
    for n in (1, 2, 300, 5000):
        keys = [str(i * i).encode() for i in range(n)]
        found = byte_bpe.PerfectHash(keys)
        assert [found.find(k) for k in keys] == list(range(n)) and len(found.key) == n
        assert found.find(b"none of them") == -1
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a", b"a"])


def test_encoding_is_the_librarys(reference):
    model = byte_bpe.load(*byte_bpe.default_ranks())
    for text in made(3000) + HARD:
        assert model.encode(text) == reference.encode_ordinary(text or "")
        assert model.decode(model.encode(text)) == (text or "").encode()
    for piece in (b"ab" * 700, b"\xff\xfe\x00", b"aaaa", b"a"):
        assert list(model.merge(piece)) == reference._encode_single_piece(piece) if len(piece) > 1 else True


def test_long_texts_are_cut_into_parts(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(byte_bpe, "GROUP_WORDS", 7)
    model = byte_bpe.load(*byte_bpe.default_ranks())
    texts = [" ".join(made(10, s)) for s in range(20)] + HARD
    got = defaultdict(list)
    for i, ids in byte_bpe.encoded(texts, model.splitter.parts, model.word):
        got[i] += ids.tolist()
    assert [got[i] for i in range(len(texts))] == [reference.encode_ordinary(t or "") for t in texts]


def test_byte_bpe_query(spark, sf, reference):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = Q.op11_byte_bpe(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def hard_docs(spark):
    return spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(HARD)] + [("x", "no number", ""), (None, "no id", ""), ("3", "again", ""), ("3", "again", "")], "doc_id string, text string, n_tokens string")


def test_rows_of_any_kind(spark, reference):
    docs = hard_docs(spark)
    for f in (byte_bpe.encode_documents, byte_bpe.token_digests):
        rows = f(docs, *byte_bpe.default_ranks()).collect()
        assert Counter(r.doc_id for r in rows)[3] == 3 and len(rows) == len(HARD) + 4 and sum(r.doc_id is None for r in rows) == 2
        assert f(docs.limit(0), *byte_bpe.default_ranks()).count() == 0
    ids = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.encode_documents(docs.limit(len(HARD)), *byte_bpe.default_ranks()).collect()}
    assert ids == {i: (reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(HARD)}


# ---- alignment ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), align.load(*align.default_files()).transducer


def plainly(sides, text):
    """Both sides' ids by the libraries, groups by common ends, links by comparing all ranges."""
    t, s, of = sides
    if not text:
        return [], [], [], []
    a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
    if b"".join(of.first[i] for i in a) != (" " + text).encode() or b"".join(of.second[i] for i in b) != (" " + text).encode():
        return [], [], [], []
    ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((of.first, a), (of.second, b))]
    spans = [list(zip([0, *e[:-1]], e)) for e in ends]
    links, first = [], 0
    for (x, y), i in zip(spans[0], a):
        while spans[1][first][1] <= x:
            first += 1
        for (u, v), j in zip(spans[1][first:], b[first:]):
            if u >= y:
                break
            links.append((i, j))
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return a, b, groups, links


def plain_rows(sides, texts):
    found = [plainly(sides, t) for t in texts]
    count = Counter(link for f in found for link in f[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, links in found]


def test_units_give_what_whole_texts_give(sides):
    pair = align.load(*align.default_files())
    texts = made(1500, 7) + HARD + ["a\n  b  \n c\n\n", "x  y\t z ", "\n "]
    for text, got in zip(texts, pair.align(texts), strict=True):
        a, b, groups, links = plainly(sides, text)
        assert got[:4] == (len(a), len(b), len(groups), ";".join(groups))
        assert sorted((x >> 20, x & (1 << 20) - 1) for x in np.frombuffer(got[4], np.int64).tolist()) == sorted(links)


def test_alignment_counts_over_all_documents(spark, sides, monkeypatch):
    docs = hard_docs(spark)
    found = align.align_documents(docs, *align.default_files()).collect()
    rows = docs.collect()
    want = Counter(zip([int(r.doc_id) if (r.doc_id or "").isdigit() else None for r in rows], plain_rows(sides, [r.text for r in rows])))
    assert Counter((r.doc_id, tuple(r)[1:]) for r in found) == want
    assert align.align_documents(docs.limit(0), *align.default_files()).count() == 0
    groups = {r.doc_id: r.groups for r in align.aligned_groups(docs.filter("doc_id = '9'"), *align.default_files()).collect()}
    assert groups == {9: plainly(sides, HARD[9])[2]}


def test_alignment_query(spark, sf, sides):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], plain_rows(sides, [r.text for r in docs])))
    assert {r.doc_id: tuple(r)[1:] for r in Q.op12_token_alignment(spark, sf).collect()} == want


# ---- intervals ------------------------------------------------------------------------------------------------------

SALES, LINES, CLICKS = "sale_id long, client_id long, status string, sold_at timestamp_ntz", "sale_id long, shipped_at timestamp_ntz, client_id string", "client_id long, ts timestamp_ntz, kind string, n string"


def loops(sales, lines, clicks):
    epoch, slot = datetime(1970, 1, 1), lambda t: (t - datetime(1970, 1, 1)) // timedelta(hours=6)
    by_client = defaultdict(list)
    for c, t, kind, *_ in clicks:
        if c is not None and t is not None:
            by_client[c].append((t, kind == "error"))
    runs = defaultdict(list)
    for c, found in by_client.items():
        for t, bad in sorted(found):
            if runs[c] and t - runs[c][-1][1] <= timedelta(minutes=30):
                last = runs[c][-1]
                runs[c][-1] = [last[0], t, bad or (last[2] and last[1] == t)]
            else:
                runs[c].append([t, t, bad])
    out = {}
    for sale_id, c, status, sold in sales:
        if c is None or sold is None:
            continue
        end = max([sold] + [s for i, s, *_ in lines if i is not None and i == sale_id and s is not None])
        a = (slot(sold), float("inf") if status == "open" else slot(end))
        for first, last, is_open in runs[c]:
            b = (slot(first), float("inf") if is_open else slot(last))
            if a[0] <= b[1] and b[0] <= a[1]:
                start, stop = (a[0] > b[0]) - (a[0] < b[0]), (a[1] > b[1]) - (a[1] < b[1])
                relation = intervals.RELATIONS[start + 1][stop + 1]
                n, shared, crc = out.get((sale_id, relation), (0, None, 0))
                both = min(a[1], b[1]) - max(a[0], b[0]) + 1
                micros = (first - epoch) // timedelta(microseconds=1)
                out[sale_id, relation] = n + 1, shared if both == float("inf") else (shared or 0) + both, crc + zlib.crc32(str(micros).encode())
    return out


def shop(seed, start, span):
    rng = random.Random(seed)
    at = lambda: rng.choice([None] + [start + timedelta(microseconds=int(rng.random() ** 2 * span.total_seconds() * 1e6)) for _ in range(15)])
    client = lambda: rng.choice([1, 1, 1, 2, 3, None])
    sales = [(rng.choice([i, i, 5, None]), client(), rng.choice(["open", "done", None]), at()) for i in range(60)]
    lines = [(rng.choice([*range(60), None]), at(), "x") for _ in range(90)]
    clicks = [(client(), at(), rng.choice(["error", "view", None]), "x") for _ in range(150)]
    clicks += [(c, t + timedelta(minutes=m, microseconds=u), k, "x") for c, t, k, _ in clicks[:40] if t for m, u in ((30, 0), (60, 1), (0, 0))]
    return sales, lines, clicks


@pytest.mark.parametrize("seed, start, days", [(1, datetime(2024, 1, 1), 20), (2, datetime(1969, 12, 1), 60), (3, datetime(2024, 1, 1, 1), 0.5), (4, datetime(1950, 1, 1), 150_000)])
def test_intervals_equal_plain_loops(spark, seed, start, days):
    sales, lines, clicks = shop(seed, start, timedelta(days=days))
    made = [spark.createDataFrame(rows, cols) for rows, cols in ((sales, SALES), (lines, LINES), (clicks, CLICKS))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = intervals.sales_and_sessions(*made).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {(r.sale_id, r.relation): tuple(r)[2:] for r in rows} == loops(sales, lines, clicks) and len(rows) == len({(r.sale_id, r.relation) for r in rows})


def test_intervals_of_empty_tables(spark):
    sales, lines, clicks = shop(1, datetime(2024, 1, 1), timedelta(days=9))
    empty = [spark.createDataFrame([], c) for c in (SALES, LINES, CLICKS)]
    full = [spark.createDataFrame(rows, c) for rows, c in ((sales, SALES), (lines, LINES), (clicks, CLICKS))]
    assert intervals.sales_and_sessions(*empty).count() == intervals.sales_and_sessions(full[0], full[1], empty[2]).count() == intervals.sales_and_sessions(empty[0], full[1], full[2]).count() == 0
    rows = intervals.sales_and_sessions(full[0], empty[1], full[2]).collect()
    assert {(r.sale_id, r.relation): tuple(r)[2:] for r in rows} == loops(sales, [], clicks)


# ---- repaired cases of the earlier operators ------------------------------------------------------------------------


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_are_one_document(spark, seed):
    rng = random.Random(seed)
    bases = [[f"t{k}w{rng.randrange(900)}" for _ in range(40)] for k in range(6)]
    rows = []
    for _ in range(60):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 9])):
            ws[rng.randrange(40)] = f"x{rng.randrange(10**6)}"
        rows.append((rng.randrange(30), " ".join(ws)))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for i, a in sets:
        for j, b in sets:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(i, find(i)) for i, _ in rows}


def test_one_id_with_most_rows_has_neighbours(spark):
    rng = random.Random(1)
    rows = [(7, [rng.gauss(0, 1) for _ in range(8)]) for _ in range(3000)] + [(50, [1.0] * 8)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(50, 1, 7)]
    same = [(7, [1.0, 2.0])] * 500 + [(50, [1.0, 1.0])]
    assert [(r.query_id, r.vec_id) for r in ann.nearest(spark.createDataFrame(same, "vec_id int, embedding array<float>")).collect()] == [(50, 7)]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_any_type(spark, sf, kind):
    cast = lambda name: table(spark, sf, name).withColumn("doc_id", F.col("doc_id").cast(kind))
    docs, labels = cast("documents").limit(60), cast("labels")
    assert sentencepiece_bpe.token_digests(docs, sentencepiece_bpe.default_model()).select("doc_id").distinct().count() == 60
    assert language_id.predict(docs, language_id.train(docs)).count() == 60
    assert secrets.scan(docs).select("doc_id").distinct().count() == 60
    assert quality_model.score(docs, quality_model.train(cast("documents"), labels)).count() == 60


def test_nothing_of_the_article_is_lost():
    long = lambda k: "<p>" + " ".join(f"word{k}{i} and the" for i in range(30)) + ".</p>"
    body = "".join(map(long, range(6)))
    page = f"""<html><body><nav><ul><li><a href=x>Home</a></li><li><a>News</a></li></ul></nav><article><h1>Title of it</h1>{body}
        <section class="discussion"><h2>Discussion</h2>{long("d")}</section><p>See <a href=x>a very long link text that goes on and on</a>.</p>
        <p>Given <math><mi>x</mi><annotation>tex</annotation></math> it <svg><text>no</text></svg>holds <button>click</button>well and good for all of us here.</p>
        <h2>References</h2><ol><li><a href=a>Smith, A. On things. 2001</a></li><li><a href=b>Jones, B. On other things. 2003</a></li></ol></article>
        <section class="discussion"><p>First! {long("reader")}</p></section><aside><h3>Related</h3><ul><li><a>More of it</a></li></ul></aside><footer>Copyright</footer></body></html>"""
    text = html_extract.extract_text(page).split("\n\n")
    assert text[0] == "Title of it" and len(text) == 14
    assert text[7] == "Discussion" and text[9:] == ["See a very long link text that goes on and on.", "Given x it holds well and good for all of us here.", "References", "Smith, A. On things. 2001", "Jones, B. On other things. 2003"]
