"""Splitting of glued words against all cuts, topics against plain loops."""

import itertools
import random

import pytest

from codexlake.functions.topics import TOPICS
from codexlake.operators import tagging, wordsplit


def all_cuts(word, cost):
    """The best of all ways to cut a word into known words, tried one after the other."""
    best = None
    for places in itertools.chain.from_iterable(itertools.combinations(range(1, len(word)), k) for k in range(len(word))):
        parts = [word[a:b] for a, b in itertools.pairwise((0, *places, len(word)))]
        if all(p in cost for p in parts):
            found = (sum(cost[p] for p in parts), len(parts), [-len(p) for p in parts], parts)
            best = found if best is None else min(best, found)
    return best and best[3]


@pytest.mark.parametrize("seed", range(3))
def test_splits_are_the_best_of_all_cuts(spark, seed):
    rng = random.Random(seed)
    cost = {"".join(rng.choices("ab", k=rng.randint(1, 4))): rng.randint(1, 9) for _ in range(12)}
    words = sorted({"".join(rng.choices("ab", k=rng.randint(6, 11))) for _ in range(40)})
    rows = wordsplit.glued_parts(spark.createDataFrame([(w,) for w in words + words[:5]], "word string"), spark.createDataFrame(list(cost.items()), "word string, cost long"), least=6)
    want = {w: parts for w in words if (parts := all_cuts(w, cost)) and len(parts) > 1}
    assert {r.word: r.parts for r in rows.collect()} == want and rows.count() == len(want) and want


def test_glued_titles(spark):
    corpus = spark.createDataFrame([("a diamond in the rough, and diamonds in the rough; the rest is history",), (None,), ("",), ("in the end the in the",)], "text string")
    costs = wordsplit.word_costs(corpus, "text")
    rows = [(1, "Diamondsintherough  by X", 7), (1, "Diamondsintherough  by X", 7), (2, None, 7), (3, "", 7), (None, "Diamondsintherough", 7), (4, "Diamondsintherouqh DIAMONDSINTHEROUGH Diamonds", 7)]
    out = wordsplit.split_glued(spark.createDataFrame(rows, "id int, text string, word int"), "id", "text", costs)
    assert out.columns == ["id", "text", "word"]
    got = sorted((r.id or 0, r.text) for r in out.collect() if r.text is not None)
    assert got == [(0, "Diamonds in the rough"), (1, "Diamonds in the rough by X"), (1, "Diamonds in the rough by X"), (3, ""), (4, "Diamondsintherouqh DIAMONDSINTHEROUGH Diamonds")]
    assert out.filter("text IS NULL").count() == 1
    none = wordsplit.word_costs(corpus.limit(0), "text")
    assert none.count() == 0 and wordsplit.split_glued(out, "id", "text", none).count() == len(rows)


def test_glued_names_come_back(spark, sf):
    from codexlake.registry import queries

    names = {r.p_partkey: f"{r.p_name} {r.p_type}" for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    rows = queries()["h31_glued_words"](spark, sf).collect()
    long = [r for r in rows if len(names[r.p_partkey].replace(" ", "")) >= wordsplit.GLUED]
    assert len(rows) == len(names) and all(r.title.replace(" ", "").lower() == names[r.p_partkey].replace(" ", "").lower() for r in rows)
    assert sum(r.title.lower() == names[r.p_partkey].lower() for r in long) >= 0.95 * len(long) > 0


def test_topics_equal_plain_loops(spark):
    rng = random.Random(5)
    triggers = [t for of in TOPICS.values() for t in of]
    texts = ["".join(rng.choice(triggers) + rng.choice(["", " ", "s ", "x"]) for _ in range(rng.randint(0, 4))) for _ in range(300)] + ["", None, "dna" * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {i: [k for k, of in TOPICS.items() if t is not None and any(x in t for x in of)] for i, t in enumerate(texts)}
    assert {r.id: r.topics for r in tagging.topic_tags(rows, text=rows.text).collect()} == want
    other = {"one": ["ab", "bc"], "all": [""], "none": [], "two": ["bc"]}
    few = spark.createDataFrame([("abc",), ("bcd",), ("x",), (None,)], "text string")
    assert [r.topics for r in tagging.topic_tags(few, other, few.text).collect()] == [["one", "all", "two"], ["one", "all", "two"], ["all"], []]
    assert tagging.topic_tags(few.limit(0), text=few.text).count() == 0
