"""Is this candidate the work that a damaged reference means? A fitted logistic model, and the rules for books."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.functions.text import sequence_ratio

# Words that carry no meaning in titles, and those a title that was cut off may end in.
STOP = frozenset(
    "the a an of in on and or to for with by from as at is are its into via de la le el der die das und do da dos em e o os um uma del les des du y en et il sur zur zum von".split()
)
BOOK_STOP = frozenset("the a an of in on and or to for with by from as at de la le el der die das und do da dos em e o os um uma del les des du y en et il lo los las".split())
CUT_STOP = frozenset("and of the a an for to in on with from by at or as de la le et und der die das do da e o".split())
# Words of works about other works, part numbers, and the weights of the fitted model (bias last).
ABOUT = frozenset("review reviews precis reply replies response comment comments correction erratum corrigendum discussion rejoinder abstract abstracts".split())
ABOUT_PAIRS = frozenset({("critical", "notice"), ("book", "note"), ("book", "notes")})
ROMAN = frozenset("i ii iii iv v vi vii viii ix x".split())
FEATURES = (
    "cov", "miss_mid", "rev", "lead", "marker", "author_conflict", "author_unknown", "ydiff", "year_unknown", "seq", "n_kw", "order", "tail", "short_cand_on_trunc", "num_conflict", "is_filename", "lead_x_filename",
)
WEIGHTS = (2.3205, -2.8156, 2.2498, 0.3169, -0.7249, -0.2223, -1.1344, -5.2013, -1.7042, 2.6991, 0.7586, 3.3179, 0.9456, -2.0172, -0.7131, -0.5397, -1.2072, -5.9827)
ACCEPT, JUDGE = 0.85, 0.30


class Work(NamedTuple):
    title: str
    authors: Sequence[str]
    year: int | None
    kind: str | None = None


class _Unmarked(dict):
    """A table for translate() that drops marks, filled with the characters it meets."""

    def __missing__(self, c: int) -> int | None:
        self[c] = kept = None if unicodedata.combining(chr(c)) else c
        return kept


_UNMARKED = _Unmarked()


@functools.lru_cache(maxsize=16)  # the titles of one pair, which are asked for again and again
def plain(s: str | None) -> str:
    """Lower case without marks."""
    s = s or ""
    return (s if s.isascii() else unicodedata.normalize("NFKD", s).translate(_UNMARKED)).lower()


@functools.lru_cache(maxsize=16)
def _words(s: str | None) -> tuple[str, ...]:
    return tuple(re.findall(r"\w+", plain(s)))


def telling(s: str | None) -> list[str]:
    """The words of a title that carry meaning: ASCII letters and digits, three and more."""
    return [w for w in re.findall(r"[a-z0-9]{3,}", plain(s)) if w not in STOP]


def _name_parts(people: Sequence[str]) -> set[str]:
    return {w for p in people for w in re.findall(r"[a-z]{3,}", plain(p))}


def _numbers(s: str) -> set[str]:
    return {w for w in _words(s) if w in ROMAN or (len(w) <= 3 and w.isdecimal())}


def _initials_and_name(s: str) -> bool:
    """A title that begins like a review's, with up to three initials, one or two names and a full stop: 'A. J. Kempner. ...'."""
    capital = lambda c: "A" <= c <= "Z"
    initials = 0
    while initials < 3 and len(s) > 1 and capital(s[0]) and s[1] == ".":
        s, initials = s[3:] if s[2:3].isspace() else s[2:], initials + 1
    head, _, tail = s.partition(".")
    names = re.split(r"\s", head)
    is_name = lambda w: len(w) > 1 and capital(w[0]) and all(c.isalnum() or c in "_'-" for c in w)
    return initials > 0 and len(names) <= 2 and all(map(is_name, names)) and tail[:1].isspace()


def _is_about(s: str) -> bool:
    words = _words(s)
    return not ABOUT.isdisjoint(words) or not ABOUT_PAIRS.isdisjoint(zip(words, words[1:]))


def _in_order(want: list[str], have: list[str]) -> tuple[int, int]:
    """(words found, words left): every wanted word at the first word behind the last one found that begins with it."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(have):
        places.setdefault(w, []).append(i)
    known, found, behind = sorted(places), 0, 0
    for w in want:
        first = len(have)
        for k in range(bisect_left(known, w), len(known)):
            if not known[k].startswith(w):
                break
            at = places[known[k]]
            i = bisect_left(at, behind)
            first = min(first, at[i] if i < len(at) else first)
        if first < len(have):
            found, behind = found + 1, first + 1
    return found, len(have) - behind


def features(seed: Work, cand: Work, hint_author: str | None = None, hint_year: int | None = None) -> list[float]:
    """The 17 values of FEATURES. A hint is the author and year that a file-like title names; its words do not count."""
    raw = re.sub(r"(?i)^(?:microsoft word|untitled)\s*-\s*|\.(?:pdf|docx?|tex|dvi|ps|indd)$|\(\d\)$|_", " ", seed.title).strip()
    said = {*telling(hint_author), str(hint_year)} if hint_author else set()
    want, have = [w for w in telling(raw) if w not in said], telling(cand.title)
    of_file, n = float(bool(hint_author)), max(1, len(want))

    known, wanted = set(have), set(want)
    lacking = [i for i, w in enumerate(want) if w not in known]
    if lacking and lacking[-1] == len(want) - 1 and any(x.startswith(want[-1]) for x in known):
        lacking.pop()  # the last word may be cut off
    inside = [i for i in lacking if i < len(want) - 1]
    begin = have.index(want[0]) if want and want[0] in known else len(have)
    lead = min(begin, 6) / 6

    in_order, rest = _in_order(want, have)
    tail = min(rest, 6) / 6 if in_order else 1.0

    words = _words(raw)
    cut_end, cut_front = bool(words) and words[-1] in CUT_STOP, raw[:1].islower() and not hint_author
    parts, cand_parts = _numbers(raw), _numbers(cand.title)
    marker = (_is_about(cand.title) or _initials_and_name(cand.title)) and not _is_about(seed.title)
    a, b = _name_parts([*seed.authors, *([hint_author] if hint_author else [])]), _name_parts(cand.authors)
    year = hint_year or seed.year
    gap = min(abs(year - cand.year), 5) / 5 if year and cand.year else 0.0
    return [
        1 - len(lacking) / n if want else 0.0, len(inside) / n, sum(w in wanted for w in have) / max(1, len(have)), lead, float(marker),
        float(bool(a and b and a.isdisjoint(b))), float(not a), gap, float(not (year and cand.year)),
        sequence_ratio(" ".join(want), " ".join(have)), min(len(want), 12) / 12, in_order / n, tail,
        float((cut_end and tail == 0) or (cut_front and lead == 0)), float(bool(parts) and parts.isdisjoint(cand_parts)), of_file, lead * of_file,
    ]


def file_hint(title: str | None) -> tuple[str | None, int | None]:
    """(author, year) of a file-like title 'Author [and Other] 1999 words'."""
    t = " ".join((title or "").split())
    m = re.match(r"([A-Z][\w'-]*(?:\s(?:and|&|et al\.?)\s[A-Z][\w'-]+)?(?:\s[A-Z][\w'-]+)?)\s+((?:1[6-9]|20)\d\d)[a-z]?\s+.{6,}$", t)
    return (m[1], int(m[2])) if m and telling(m[1]) else (None, None)


def judge(seed: Work, cand: Work) -> tuple[float, bool, str]:
    """(probability, veto, accept / judge / reject).

    Vetoes: no author in common, more than three years apart, a book against a journal article. What looks like a
    review of the work never gets past the judge.
    """
    author, hint_year = file_hint(seed.title)
    own = seed._replace(authors=list(seed.authors)[:4], year=seed.year if seed.year and 1400 <= seed.year <= 2027 else None)
    x = features(own, cand._replace(authors=list(cand.authors)[:4]), author, hint_year)
    p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(WEIGHTS, [*x, 1.0]))))
    year = hint_year or own.year
    far = bool(year and cand.year and abs(year - cand.year) > 3)
    veto = x[FEATURES.index("author_conflict")] > 0 or far or (seed.kind in ("book", "monograph") and cand.kind in ("journal-article", "article"))
    review = "<i>" in cand.title or re.match(r"(?:[A-Z]\.\s?){1,3}[A-Z][\w'-]+\s*(?:<i>|[.:])", cand.title) or re.match(r"(?i)\s*(?:book )?review\s*[:.]", cand.title)
    if review and "<i>" not in seed.title and not _is_about(seed.title):
        p = min(p, JUDGE + 0.2)
    return p, veto, "reject" if veto or p < JUDGE else "accept" if p >= ACCEPT else "judge"


def _works(title: pd.Series, authors: pd.Series, year: pd.Series, kind: pd.Series) -> list[Work]:
    return [Work(t or "", [a for a in (ps if ps is not None else []) if a], None if y is None or y != y else int(y), k) for t, ps, y, k in zip(title, authors, year, kind)]


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(seed_* and cand_*: title, authors array<string>, year, kind; more columns) with p, veto, verdict."""

    @F.pandas_udf("p double, veto boolean, verdict string")
    def run(st: pd.Series, sa: pd.Series, sy: pd.Series, sk: pd.Series, ct: pd.Series, ca: pd.Series, cy: pd.Series, ck: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(s, c) for s, c in zip(_works(st, sa, sy, sk), _works(ct, ca, cy, ck))], columns=["p", "veto", "verdict"])

    return pairs.withColumn("_j", run(*[f"{side}_{c}" for side in ("seed", "cand") for c in ("title", "authors", "year", "kind")])).select(*pairs.columns, "_j.*")


# ---- books ----------------------------------------------------------------------------------------------------------


def _book_words(s: str | None) -> list[str]:
    return [w for w in re.findall(r"[a-z0-9]+", plain(s)) if w not in BOOK_STOP]


def book_title_fits(seed: str | None, cand: str | None) -> str | None:
    """'whole' or 'short' if 85 % of the title's words occur in the other, or the two (or the other's main title) are nearly equal.

    Titles of fewer than two telling words never fit; 'short' ones (two words, or under half of the other's) need the year too.
    """
    want, have = (_book_words(t) for t in (seed, cand))
    heavy = [w for w in want if len(w) > 2]
    if len(heavy) < 2:
        return None
    near = lambda other: bool(other) and sequence_ratio(" ".join(want), " ".join(other)) >= 0.9
    if sum(w in set(have) for w in heavy) < 0.85 * len(heavy) and not near(have) and not near(_book_words((cand or "").split(":")[0])):
        return None
    return "short" if len(heavy) <= 2 or 2 * len(heavy) < sum(len(w) > 2 for w in have) else "whole"


def pick_books(seeds: DataFrame, volumes: DataFrame) -> DataFrame:
    """seeds(seed_id, title, surname, year), volumes(seed_id, pos, title, names array, first_year, year, isbn) -> seed_id, pos, isbn.

    The first volume by pos with an ISBN whose title fits, that has the surname among its authors, and was not first
    published later than a year after the seed's year. For short titles one of its years must be within two of the seed's.
    """

    @F.pandas_udf("string")
    def fits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([book_title_fits(x, y) for x, y in zip(a, b)], dtype=object)

    @F.pandas_udf("boolean")
    def named(surname: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([bool(s) and plain(s) in {w for n in (ns if ns is not None else []) for w in re.findall("[a-z]+", plain(n))} for s, ns in zip(surname, names)])

    v = volumes.select("seed_id", "pos", F.col("title").alias("_title"), "names", "first_year", F.col("year").alias("_year"), "isbn").filter("isbn <> ''")
    x = v.join(seeds.select("seed_id", "title", "surname", "year"), "seed_id").filter("year IS NULL OR first_year IS NULL OR year >= first_year - 1")
    x = x.withColumn("_fit", fits("title", "_title")).filter(F.col("_fit").isNotNull() & named("surname", "names"))
    close = F.least(F.abs(F.col("year") - F.col("first_year")), F.abs(F.col("year") - F.col("_year"))) <= 2
    x = x.filter((F.col("_fit") == "whole") | F.coalesce(close, F.lit(False)))
    return x.groupBy("seed_id").agg(F.min(F.struct("pos", "isbn")).alias("b")).select("seed_id", "b.pos", "b.isbn")
