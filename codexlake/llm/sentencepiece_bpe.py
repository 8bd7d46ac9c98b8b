"""SentencePiece (BPE) encoding by backtracking, and decoding.

Encoding takes the longest vocabulary entry at each place (Aho-Corasick), and keeps it only if it is compatible with
the token before it: re-merging the two tokens' text must never join across their border. Where no entry fits, the last
token is shortened or given up, and a bitfield remembers places from which no encoding exists, so the work stays linear.
The result equals merging by priority, because a sequence of pairwise compatible tokens is unique.

Only white-space marks tie in priority; their runs are joined by rule (see _segment). No piece has a mark after another
character, so a text falls into independent segments, each encoded once per worker and cached.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]*")
#: Segments kept in a worker's cache, the longest one that is kept, and pairs of tokens kept; full caches make way (of segments, the last generation is kept).
CACHE_SEGMENTS, CACHE_CHARS, CACHE_PAIRS = 250_000, 48, 300_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def segments(text: str, mark: bool = True) -> list[str]:
    """A text with its spaces as marks (and one before it), cut before each run of marks: no token crosses a cut."""
    return [s for s in _SEGMENT.findall(MARK * mark + text.replace(" ", MARK)) if s]


class PieceModel:
    """A BPE model with byte fallback, an identity normaliser, a dummy prefix and escaped white space."""

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif number == 3:
                normaliser = dict(_fields(value))
                if normaliser.get(2) or normaliser.get(3, 1) != 1 or normaliser.get(4, 1) != 0 or normaliser.get(5, 1) != 1:
                    raise ValueError("only an identity normaliser with a dummy prefix and escaped white space is supported")
        if 4 in self.kinds or 5 in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 1}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = self.kinds.index(2)
        if any(MARK in p.lstrip(MARK) or (len(p) > 1 and p[0] == MARK and p[1] == MARK and p.strip(MARK)) for p in self.ids):
            raise ValueError("pieces with a white-space mark inside are not supported")
        self.runs = {len(p) for p in self.ids if not p.strip(MARK)}
        if len({scores[self.ids[MARK * n]] for n in self.runs}) > 1 or scores[self.ids[MARK]] > min(scores[i] for p, i in self.ids.items() if p.strip(MARK)):
            raise ValueError("runs of white-space marks must tie below all other pieces")
        # smaller rank: merged earlier
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.characters = {p for p in self.ids if len(p) == 1}
        self._find_splits()
        self.automaton = ahocorasick.Automaton()
        for p in self.split:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self._shorter = lru_cache(1 << 16)(self._shorter_uncached)
        self._fitting: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, tuple[str, int, str]] = {}
        self._older: dict[str, tuple[str, int, str]] = {}

    def _find_splits(self) -> None:
        """The pair whose merge makes each piece; pieces that merging by priority never makes are left out."""
        for p in sorted(self.ids, key=lambda x: (self.rank[x], len(x))):
            if len(p) == 1:
                self.split[p] = None
            elif p.strip(MARK):
                parts = self._merge(p)
                if len(parts) == 2:
                    self.split[p] = (parts[0], parts[1])
                elif any(len(x) > 1 and x not in self.split for x in self.ids if x in p and x != p):
                    raise ValueError(f"{p}: made from pieces of later priority")

    def _merge(self, text: str) -> list[str]:
        """Merging by priority with the pieces found so far, the piece itself not among them."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                joined = parts[i] + parts[i + 1]
                if joined in self.split and (best is None or self.rank[joined] < best):
                    best, at = self.rank[joined], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _shorter_uncached(self, piece: str) -> str | None:
        """The longest usable piece that is a proper prefix of this one."""
        for n in range(len(piece) - 1, 0, -1):
            if piece[:n] in self.split:
                return piece[:n]
        return None

    def _fits(self, left: str, right: str) -> bool:
        if len(self._fitting) >= CACHE_PAIRS:
            self._fitting.clear()
        found = self._fitting[left, right] = self._border_holds(left, right)
        return found

    def _border_holds(self, left: str, right: str) -> bool:
        """Would merging by priority, on the two pieces' text, keep the border between them?

        Undoes merges from the latest on, on whichever side was merged later, and looks whether the pieces that touch
        the border would have been joined before that merge.
        """
        limit = float("inf")
        while True:
            joined = left + right
            if joined in self.split and self.rank[joined] < limit:
                return False
            undo_left, undo_right = self.split[left], self.split[right]
            if undo_left is None and undo_right is None:
                return True
            rank_left = self.rank[left] if undo_left else -1.0
            rank_right = self.rank[right] if undo_right else -1.0
            if rank_left > rank_right:
                limit, left = rank_left, undo_left[1]
            else:  # of equal merges the left one comes first: a border merge as good as the right side's wins
                limit, right = rank_right + 0.5, undo_right[0]

    def _backtrack(self, text: str) -> list[str]:
        """Tokens of a text whose characters are all pieces, without runs of marks."""
        n = len(text)
        longest: list = [None] * (n + 1)
        for end, (piece, size) in self.automaton.iter(text):
            longest[end - size + 1] = piece  # of matches from one place the longest comes last
        fits, fits_of = self._fitting, self._fits
        failed = 0  # a bitfield over places
        out: list[str] = []
        at, last, token = 0, "", longest[0]
        while token is not None:
            end = at + len(token)
            if not failed >> end & 1:
                ok = True
                if last:
                    pair = (last, token)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits_of(last, token)
                if ok:
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    continue
            token = self._shorter(token)
            while token is None:  # nothing fits here: give up the token before
                failed |= 1 << at
                if not out:
                    raise ValueError("no encoding")
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else ""
                token = self._shorter(token)
        return out

    def _segment(self, segment: str) -> tuple[list[int], str]:
        """Ids of white-space marks and what follows them up to the next mark, and what they decode to."""
        chars = self.characters
        if segment[:1] == MARK and segment[1:2] != MARK and chars.issuperset(segment):
            tokens = self._backtrack(segment)
            of = self.ids
            return [of[t] for t in tokens], "".join(tokens).replace(MARK, " ")
        body = segment.lstrip(MARK)
        marks = len(segment) - len(body)
        tail: list[int] = []
        start, first = 0, True
        text = (MARK if marks else "") + body
        while start < len(text):
            stop = start
            while stop < len(text) and text[stop] in chars:
                stop += 1
            if stop > start:
                tokens = self._backtrack(text[start:stop])
                if first and marks and tokens[0] == MARK:
                    tokens = tokens[1:]
                elif first and marks:
                    marks -= 1
                first = False
                tail.extend(self.ids[t] for t in tokens)
            start = stop
            while start < len(text) and text[start] not in chars:
                first = False
                tail.extend(self.byte_id[b] for b in text[start].encode("utf-8", "surrogatepass")) if self.byte_id else tail.append(self.unknown)
                start += 1
        run: list[int] = []  # of equal priorities the leftmost pair comes first, so a run grows from the left
        for _ in range(marks):
            size = 1
            while run and run[-1] + size in self.runs:
                size += run.pop()
            run.append(size)
        ids = [self.ids[MARK * size] for size in run]
        ids += tail
        return ids, self._pieces_text(ids)

    def _known(self, segment: str) -> tuple[str, int, str]:
        """(ids joined by commas, their number, decoded text with its marks as spaces)."""
        found = self._cache.get(segment)
        if found is None:
            found = self._older.get(segment)
            if found is not None:
                self._cache[segment] = found
        if found is None:
            ids, decoded = self._segment(segment)
            found = (",".join(map(str, ids)), len(ids), decoded)
            if len(segment) <= CACHE_CHARS:
                if len(self._cache) >= CACHE_SEGMENTS:
                    self._older, self._cache = self._cache, {}
                self._cache[segment] = found
        return found

    def forget(self) -> None:
        """Empty the caches."""
        self._cache, self._older = {}, {}
        self._fitting.clear()
        self._shorter.cache_clear()

    def _pieces_text(self, ids: list[int]) -> str:
        parts: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                parts.append(pending.decode("utf-8", "replace"))
                pending.clear()
            parts.append(" ⁇ " if self.kinds[i] == 2 else "" if self.kinds[i] == 3 else self.pieces[i].replace(MARK, " "))
        if pending:
            parts.append(pending.decode("utf-8", "replace"))
        return "".join(parts)

    def encode(self, text: str) -> list[int]:
        """Ids as the library's encode gives them, without begin or end ids."""
        if not text:
            return []
        ids: list[int] = []
        for s in _SEGMENT.findall(MARK + text.replace(" ", MARK)):
            if s:
                ids.extend(self._segment(s)[0])
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text as the library's decode gives it: the dummy prefix is taken off."""
        text = self._pieces_text(ids)
        return text[1:] if ids and self.kinds[ids[0]] == 1 and self.pieces[ids[0]].startswith(MARK) else text

    def encode_and_decode(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by commas, their number, decoded text), through the cache of segments."""
        if not text:
            return "", 0, ""
        known = self._known
        parts = [known(s) for s in _SEGMENT.findall(MARK + text.replace(" ", MARK)) if s]
        decoded = "".join([p[2] for p in parts])
        return ",".join([p[0] for p in parts]), sum([p[1] for p in parts]), decoded[1:]


@lru_cache(4)
def load_model(path: str) -> PieceModel:
    """The model of a local file, one for each worker process."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _apply(path: str, with_ids: bool, keep_caches: bool = True):
    def run(batches):
        model = load_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts, texts = [], [], []
                for text in part.column(1).to_pylist():
                    joined, n, decoded = model.encode_and_decode(text)
                    ids.append(joined)
                    counts.append(n)
                    texts.append(decoded)
                columns = [part.column(0), pa.array(counts, pa.int64())]
                if with_ids:
                    columns += [pa.array([[int(x) for x in s.split(",")] if s else [] for s in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])
                else:
                    digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                    columns += [pa.array([digest(s) for s in ids], pa.string()), pa.array([digest(s) for s in texts], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep_caches:
            model.forget()

    return run


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids array<int>, decoded string; one row per input row.

    Null and empty texts give no ids and an empty decoded text. Rows are independent of each other, other columns are
    ignored, and texts of any length are encoded whole. A doc_id that is no whole number is null in the result. The model file must be at the same path on every machine.
    """
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_apply(model_path, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model_path: str, keep_caches: bool = True) -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of ids and decoded text.

    Without keep_caches a task leaves no cached segments behind in its worker: for sessions that go on to other work.
    """
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_apply(model_path, False, keep_caches), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
