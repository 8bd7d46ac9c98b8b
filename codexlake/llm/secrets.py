"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest looks at a candidate's length, character transitions, dictionary coverage, path-likeness and neighbouring
words. The dictionary is the corpus's own: its most frequent free-standing words. The forest is trained from labelled
findings: a table of candidates with their surroundings and a verdict (findings_of), or those that labelled_findings()
makes from a seed and dictionary words (keys, hashes and passwords in the settings they are used in, against checksums,
identifiers, numbers, addresses, paths, long words and key blocks without a key). Every kind of candidate is judged by
the forest, on the whole of it; every pattern takes linear time.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import discard, written

TOKEN = re.compile(r"[A-Za-z0-9+/_\-.@:%]{16,}={0,2}")
_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
#: A name that holds one of the words, looked at once from its beginning; possessive, so nothing is tried twice.
ASSIGNED = re.compile(rf"(?i)(?<![a-z0-9_-])(?=[a-z0-9_-]*?(?:{_NAMES}))[a-z0-9_-]++[\"']?+\s*+(?:=>|:=|[:=])\s*+[\"']?+([^\s\"'<>,;]{{6,}}+)")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----")
KEYWORD = re.compile(r"(?i)pass(?:word|wd|phrase)?\b|pwd|secret|token|api.?key|access.?key|private.?key|\bauth|credential|bearer|signing.?key")
HARMLESS = re.compile(r"(?i)sha-?\d*|md5|checksum|digest|commit|revision|etag|uuid|guid|version|integrity|fingerprint|\bid\b|isbn|doi|order|invoice|phone|tel|card")
PREFIX = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|AIza|ya29\.|eyJ|SG\.|npm_|pypi-|hf_|dop_v1_)")
#: Characters of either side that count as neighbours.
AROUND = 32
#: Words of the dictionary, at most, and how often each stands in the corpus, at least.
DICTIONARY, OFTEN = 50_000, 3
#: Findings that a forest is fitted on, at most.
FINDINGS = 20_000
_PATH = re.compile(r"^[\w.+-]+@[\w-]+\.[\w.]+|^https?:|^[/~.]|\.[a-z]{2,4}$|/[a-z]+/|^\d+(?:[.\-:/ ]\d+)+$")
_RUN = re.compile(r"[^\W\d_]{4,}")
_PARTS = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Finding:
    value: str
    before: str
    after: str
    secret: bool


FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "other", "transitions", "longest_run", "hex", "distinct", "vowel_pairs", "covered",
    "path", "prefix", "keyword", "harmless", "assigned", "quoted", "numeric", "dashes", "block",
)


def _classes() -> np.ndarray:
    """Digit, capital, small letter or other of every code point of the first plane."""
    out = np.full(1 << 16, 3, np.int8)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3
    return out


_CLASS = _classes()
_HEX = np.zeros(1 << 16, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_VOWEL = np.zeros(1 << 16, bool)
_VOWEL[[ord(c) for c in "aeiouAEIOU"]] = True


def features(value: str, before: str, after: str, words: frozenset[str] = frozenset()) -> list[float]:
    """The forest's view of a candidate, all of it, between its neighbours."""
    code = np.minimum(np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    n = len(code)
    kind = _CLASS[code]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    runs = np.diff(np.concatenate(([0], change, [n])))
    counts = np.unique(code, return_counts=True)[1] / n
    letter = (kind == 1) | (kind == 2)
    vowel = _VOWEL[code]
    vowels = int(((vowel[1:] != vowel[:-1]) & letter[1:] & letter[:-1]).sum())
    near = {w.lower() for w in re.findall(r"[^\W\d_]{4,}", before + " " + after)}
    covered = sum(len(w) for run in _RUN.findall(value) for w in ([run] if run.lower() in words else _PARTS.split(run)) if w.lower() in words or w.lower() in near) / n
    left = before.rstrip()
    assigned = left.rstrip("\"'").rstrip()[-1:] in ("=", ":") or left.endswith("=>")
    share = np.bincount(kind, minlength=4) / n
    return [
        math.log2(n), float(-(counts * np.log2(counts)).sum()), *share.tolist(), len(change) / max(1, n - 1), int(runs.max()) / n,
        float(_HEX[code].all()), len(counts) / n, vowels / max(1, n - 1), covered,
        float(bool(_PATH.search(value))), float(bool(PREFIX.match(value))), float(bool(KEYWORD.search(before))), float(bool(HARMLESS.search(before))),
        float(assigned), float(before[-1:] in ("'", '"')), float(not letter.any()), value.count("-") / n, float(value.startswith("-----BEGIN")),
    ]


def dictionary(docs: DataFrame, most: int = DICTIONARY, often: int = OFTEN) -> frozenset[str]:
    """The corpus's most frequent words of 4 to 24 letters that stand free of letters and digits, lower-cased.

    Counted over all texts. Words come by levels of frequency (64 to a factor of e): the highest levels that together hold
    at most `most` words, and none seen under `often` times; no more than those reach the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])\p{L}{4,24}(?![\p{L}\p{N}])"), 0)).alias("word"))
    counted = words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)
    counted = written(counted.select("word", F.floor(64 * F.log("n")).cast("int").alias("level")), "dictionary")
    cut, total = 1 << 30, 0
    for level, n in sorted(((r["level"], r["n"]) for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):  # some 2,600 levels at most
        total += n
        if total > most:
            break
        cut = level
    found = frozenset(r["word"] for r in counted.filter(F.col("level") >= cut).select("word").collect())
    discard(counted)
    return found


def findings_of(table: DataFrame, most: int = FINDINGS) -> list[Finding]:
    """Labelled findings from a table (value, before, after, secret); at most `most`, in the order of a hash.

    Rows without a value or a verdict are left out; null neighbours are empty.
    """
    rows = table.filter("length(value) > 0 AND secret IS NOT NULL").select(
        F.col("value").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "after")], F.col("secret").cast("boolean")
    )
    rows = rows.orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after", "secret").limit(most)
    return [Finding(r["value"], r["before"][-AROUND:], r["after"][:AROUND], r["secret"]) for r in rows.collect()]


def labelled_findings(seed: int = 1, n: int = 3000, words: frozenset[str] = frozenset()) -> list[Finding]:
    """Labelled findings made from a seed, half of them secrets; their words are partly those of the dictionary."""
    rng = random.Random(seed)
    known = sorted(words)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda chars, size: "".join(rng.choice(chars) for _ in range(size))
    syllables = ["an", "er", "the", "in", "on", "ti", "st", "en", "ou", "re", "au", "sch", "ment", "que", "ción", "ar", "lo", "mi"]
    word = lambda: rng.choice(known) if known and rng.random() < 0.7 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    block = lambda body: f"-----BEGIN {rng.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----{body}-----END PRIVATE KEY-----"
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 5)))
    hexed = lambda size: pick("0123456789abcdef", size)
    out = []
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            value = rng.choice([
                lambda: hexed(rng.choice([32, 40, 48, 64])), lambda: pick(alnum, rng.randint(20, 64)), lambda: pick(alnum + "+/", 40), lambda: "AKIA" + pick(alnum[26:].upper(), 16),
                lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "-_", 35), lambda: "xoxb-" + pick("0123456789", 11) + "-" + pick(alnum, 24),
                lambda: "eyJ" + pick(alnum, 30) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum + "-_", 43), lambda: pick(alnum + "!#%&*", rng.randint(10, 18)),
                lambda: block("\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randint(2, 20))) + "\n"),
            ])()
            name = rng.choice(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "PASSWORD", "private_key", "Bearer", "credential", "passwd"])
            mark = rng.choice([" = \"", "=\"", "=", ": ", ": \"", " = '", ":"]) if name != "Bearer" else " "
            bare = value.startswith("-----") or (PREFIX.match(value) and rng.random() < 0.4)
            before = prose() + " " + ("" if bare else name + mark)
        else:
            kind = rng.randrange(11)
            name, mark = "", rng.choice(["", " "])
            if kind == 0:
                value, name, mark = hexed(rng.choice([32, 40, 64])), rng.choice(["sha256", "md5", "commit", "checksum", "digest", "etag", "revision", "sha1"]), rng.choice([": ", " = \"", " ", "="])
            elif kind == 1:
                value, name = "-".join(hexed(k) for k in (8, 4, 4, 4, 12)), rng.choice(["id", "uuid", "", "guid"])
            elif kind == 2:
                value = f"{word()}.{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com"
            elif kind == 3:
                value = pick("0123456789", 16)
            elif kind == 4:
                value = "https://" + word() + ".example.org/" + word() + "/" + str(rng.randint(0, 999))
            elif kind == 5:
                value = "/" + "/".join(word() for _ in range(4)) + rng.choice([".txt", ".py", ".html"])
            elif kind == 6:
                value = "".join(word() for _ in range(6)) + rng.choice(["", "2", "###", "1.0"])
            elif kind == 7:
                value = rng.choice(["_", "-", "."]).join(word() for _ in range(4)) + str(rng.randint(0, 99))
            elif kind == 8:
                value, name, mark = rng.choice(["changeme", "example", "placeholder", "xxxxxxxxxxxxxxxx", "your_token_here", "REDACTED", word() + word(), "**********"]), rng.choice(["password", "token", "secret"]), rng.choice([": ", "=", " = \""])
            elif kind == 9:
                value = block(rng.choice([" ", "\n"]) + prose() + rng.choice([" ", "\n", " ... "]))
            else:
                value = f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(100, 255)}" + rng.choice([":80", "/24", "###", ""]) + pick("0123456789", rng.choice([0, 6]))
            before = prose() + " " + name + mark
        out.append(Finding(value, before[-AROUND:], rng.choice(["\" ", "\"\n", " ", "' "]) + prose(), secret))
    return out


class Forest:
    """A random forest of binary trees on bootstrap samples, with Gini splits over random features."""

    def __init__(self, trees: int = 30, depth: int = 8, seed: int = 3):
        self.trees, self.depth, self.rng = trees, depth, np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.trees):
            at = self.rng.integers(0, len(y), len(y))
            feature, cut, right, value = [], [], [], []

            def grow(rows, depth):
                me = len(feature)
                feature.append(-1)
                cut.append(0.0)
                right.append(0)
                value.append(float(y[rows].mean()) if len(rows) else 0.5)
                if depth == 0 or len(rows) < 8 or value[me] in (0.0, 1.0):
                    return
                best = (np.inf, 0, 0.0)
                for f in self.rng.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False):
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    v, ones = x[order, f], np.cumsum(y[order])
                    k = np.flatnonzero(v[1:] > v[:-1])
                    if not len(k):
                        continue
                    n_left = k + 1.0
                    n_right = len(order) - n_left
                    a, b = ones[k] / n_left, (ones[-1] - ones[k]) / n_right
                    impurity = n_left * a * (1 - a) + n_right * b * (1 - b)
                    i = int(impurity.argmin())
                    best = min(best, (float(impurity[i]), int(f), float((v[k[i]] + v[k[i] + 1]) / 2)))
                if best[0] == np.inf:
                    return
                feature[me], cut[me] = best[1], best[2]
                side = x[rows, best[1]] <= best[2]
                grow(rows[side], depth - 1)
                right[me] = len(feature)
                grow(rows[~side], depth - 1)

            grow(at, self.depth)
            self.nodes.append((np.array(feature), np.array(cut), np.array(right), np.array(value)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, right, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            going = feature[at] >= 0
            while going.any():
                i = np.flatnonzero(going)
                f = feature[at[i]]
                at[i] = np.where(x[i, f] <= cut[at[i]], at[i] + 1, right[at[i]])
                going[i] = feature[at[i]] >= 0
            total += value[at]
        return total / len(self.nodes)


@dataclass(frozen=True)
class Scanner:
    forest: Forest
    words: frozenset[str]

    def judge(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        """Probability that each (value, before, after) is a secret."""
        return self.forest.predict(np.array([features(*f, self.words) for f in found])) if found else np.zeros(0)


def train(findings: list[Finding] | None = None, words: frozenset[str] = frozenset()) -> Scanner:
    """A scanner with a dictionary from labelled findings (by default the made ones)."""
    findings = labelled_findings(words=words) if findings is None else findings
    x = np.array([features(f.value, f.before, f.after, words) for f in findings])
    return Scanner(Forest().fit(x, np.array([f.secret for f in findings], dtype=float)), words)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of possible secrets in code points, in order and without overlaps.

    A key block goes from its BEGIN line to its END line, if no other such line comes first; without END it is none, and
    its lines are candidates by themselves.
    """
    found = []
    for m in _BEGIN.finditer(text) if "PRIVATE KEY-----" in text else ():
        end = _END.match(text, max(m.end(), text.find("-----", m.end())))
        if end:
            found.append((m.start(), end.end(), "private_key"))
    for m in ASSIGNED.finditer(text) if "=" in text or ":" in text else ():
        found.append((m.start(1), m.end(1), "assigned"))
    for m in TOKEN.finditer(text):
        value = m.group()
        if not value.isalpha() and any(c.isdigit() for c in value):
            found.append((m.start(), m.end(), "token"))
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def scan_texts(scanner: Scanner, texts: list[str | None], threshold: float = 0.5) -> list[tuple[int, list[tuple[int, int, str, float]]]]:
    """(number of candidates, findings (start, end, kind, probability)) of each text."""
    every = [candidates(t) if t else [] for t in texts]
    p = iter(scanner.judge([(t[a:b], t[max(0, a - AROUND) : a], t[b : b + AROUND]) for t, c in zip(texts, every) for a, b, _ in c]).tolist())
    out = []
    for c in every:
        scored = [(a, b, kind, next(p)) for a, b, kind in c]
        out.append((len(c), [s for s in scored if s[3] >= threshold]))
    return out


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with its spans replaced."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


_SPAN = "struct<start:int,end:int,kind:string,score:double>"


def scan(docs: DataFrame, scanner: Scanner | None = None, threshold: float = 0.5, redacted: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_candidates, findings array<struct>; with `redacted` also the cleaned text.

    One row per input row. Null and empty texts have no candidates (a null text stays null when redacted). Whole texts
    are scanned; findings do not overlap and come in order. Without a scanner given, one is trained with the dictionary
    of docs. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner or train(words=dictionary(docs)))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                found = scan_texts(shared.value, texts, threshold)
                columns = [part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([[dict(zip(("start", "end", "kind", "score"), s)) for s in f] for _, f in found], kind)]
                names = ["doc_id", "n_candidates", "findings"]
                if redacted:
                    columns.append(pa.array([redact(t, [s[:2] for s in f]) if f else t for t, (_, f) in zip(texts, found)], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_candidates long, findings array<{_SPAN}>" + (", text string" if redacted else ""))


def redacted(docs: DataFrame, scanner: Scanner | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with secrets in their text replaced and n_chars (if there) counted again; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner or train(words=dictionary(docs)))
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(at).to_pylist()
                found = scan_texts(shared.value, texts, threshold)
                if any(f for _, f in found):
                    clean = [redact(t, [s[:2] for s in f]) if f else t for t, (_, f) in zip(texts, found)]
                    columns = list(part.columns)
                    columns[at] = pa.array(clean, part.schema.field(at).type)
                    if count is not None:
                        old = part.column(count).to_pylist()
                        columns[count] = pa.array([len(t) if f else n for t, n, (_, f) in zip(clean, old, found)], part.schema.field(count).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, docs.schema)
