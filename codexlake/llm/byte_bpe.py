"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the vocabulary's pattern. A minimal perfect hash over the vocabulary's byte strings says whether a
whole pre-token is one of them; only those that are not are merged, by a heap of pairs over a linked list of bytes. Both
work on the distinct pre-tokens of a group of texts: their ids are then laid out in the order of the texts by Arrow's
take. Texts are cut into groups, and long ones into parts, at pre-tokens, so memory is bounded however long a text is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that are worked on at once, characters from which a text is cut into parts, pre-tokens kept with their ids.
GROUP_WORDS, LONG_TEXT, CACHE_WORDS, CACHE_CHARS = 400_000, 1 << 20, 400_000, 48
#: Keys in a bucket of the perfect hash, displacements tried at once, and at most.
BUCKET, TRIED, MOST_TRIED = 4, 2048, 1 << 20
#: Odd 64-bit multipliers that move and spread a hash.
STEP, SPREAD, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1

# Letters and numbers (first and last of each run) that the tables of regular expressions here know and
# those of the tokenizer libraries (Unicode 16) do not.
YOUNG_LETTERS = """558 558, 58b 58c, 88f 88f, c5c c5c, cdc cdc, 208f 208f, 209d 209f, a7ce a7cf, a7d2 a7d2, a7d4 a7d4, a7dd a7dd, a7e2 a7e2,
a7f1 a7f1, ab6c ab6d, 107bb 107bf, 10940 10959, 10ec5 10ec7, 10ed9 10eee, 11b0a 11b0a, 11db0 11ddb, 11df1 11df1, 16ea0 16eb8,
16ebb 16ed3, 16ff2 16ff3, 187f8 187ff, 18cd6 18cda, 18d09 18d20, 18d80 18df2, 18e00 19191, 191a0 191d2, 1b123 1b128, 1b168 1b168,
1d6a6 1d6a6, 1df1f 1df24, 1df2b 1df81, 1df90 1df96, 1dfcd 1dfff, 1e6c0 1e6de, 1e6e0 1e6e2, 1e6e4 1e6e5, 1e6e7 1e6ed, 1e6f0 1e6f4,
1e6fe 1e6ff, 2b73a 2b73f, 2b81e 2b81e, 2cea2 2cead, 323b0 33479, 3d000 3fc3f"""
YOUNGEST = "\u0558"  # the first of them
YOUNG_NUMBERS = "11de0 11de9, 1246f 1246f, 12475 1247f, 12550 12686, 16ff4 16ff6"


def _class(runs: str) -> str:
    return "".join("\\U{:0>8}-\\U{:0>8}".format(*run.split()) for run in runs.split(","))


class Splitter:
    """Pre-tokens of a text: the matches of a pattern, with \\p{L} and \\p{N} as in Unicode 16."""

    def __init__(self, pattern: str):
        letters, numbers = _class(YOUNG_LETTERS), _class(YOUNG_NUMBERS)
        self.plain = regex.compile(pattern)
        self.young = re.compile(f"[{letters}{numbers}]")
        other = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{letters}{numbers}]|[^\s\p{{L}}\p{{N}}])")
        other = re.sub(r"(?<!s)\\p\{L\}", lambda m: rf"[\p{{L}}--[{letters}]]", other.replace(r"^\s\p{L}\p{N}", "\0"))
        other = re.sub(r"\\p\{N\}", lambda m: rf"[\p{{N}}--[{numbers}]]", other).replace("\0", r"^\s\p{L}\p{N}")
        self.careful = regex.compile(other, regex.V1)

    def _for(self, text: str):
        if text.isascii() or max(text) < YOUNGEST:
            return self.plain
        return self.careful if self.young.search(text) else self.plain

    def words(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def parts(self, text: str, size: int) -> Iterator[list[str]]:
        """The pre-tokens in lists of at most `size`; a short text's are one list."""
        if len(text) <= LONG_TEXT:
            yield self.words(text)
            return
        found = (m[0] for m in self._for(text).finditer(text))
        while part := list(itertools.islice(found, size)):
            yield part


class PerfectHash:
    """A minimal perfect hash: n byte strings in n places, by hashing into buckets and displacing each bucket.

    A key's place is its hash, moved by its bucket's displacement and spread by a multiplication; the displacement is the first one that sets all the bucket's
    keys on free places; buckets of one key get a free place itself.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = self.n // BUCKET + 1
        for self.seed in range(100):
            if self._place(keys):
                return
        raise ValueError("no perfect hash was found: the keys are not distinct")

    def _place(self, keys: list[bytes]) -> bool:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, self.n)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        start = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        size = np.diff(start)
        free = np.ones(self.n, bool)
        shift = np.zeros(self.buckets, np.int64)
        place = np.zeros(self.n, np.int64)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            mine = order[start[b] : start[b + 1]]
            for first in range(0, MOST_TRIED, TRIED):
                moved = h[mine, None] ^ (np.arange(first, first + TRIED, dtype=np.uint64) * np.uint64(STEP))
                at = ((moved * np.uint64(SPREAD) >> np.uint64(24)) % np.uint64(self.n)).astype(np.int64)
                fits = free[at].all(0)
                for j in np.flatnonzero(fits):
                    if len(set(at[:, j].tolist())) == len(mine):
                        break
                else:
                    continue
                shift[b], place[mine] = first + j, at[:, j]
                free[at[:, j]] = False
                break
            else:
                return False
        left = np.flatnonzero(free)
        alone = np.flatnonzero(size == 1)
        shift[alone] = -1 - left[: len(alone)]
        place[order[start[alone]]] = left[: len(alone)]
        self.shift = shift.tolist()
        self.key: list[bytes] = [b""] * self.n
        self.number = [0] * self.n
        for i, p in enumerate(place.tolist()):
            self.key[p], self.number[p] = keys[i], i
        return True

    def find(self, key: bytes) -> int:
        """The key's number in the list that the hash was made of, -1 for other byte strings."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        at = (((h ^ (d * STEP & WORD)) * SPREAD & WORD) >> 24) % self.n if d >= 0 else -1 - d
        return self.number[at] if self.key[at] == key else -1


class ByteBPE:
    """Ranks of byte strings (all single bytes among them); a smaller rank is merged earlier."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.splitter = Splitter(pattern)
        self.tokens = list(ranks)
        self.ranks = list(ranks.values())
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("every single byte must be in the vocabulary")
        self.hash = PerfectHash(self.tokens)
        self.rank_of = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pair = [ranks.get(bytes(p), -1) for p in itertools.product(range(256), repeat=2)]
        self.token_of = dict(zip(self.ranks, self.tokens))
        texts = [self.token_of.get(i, b"") for i in range(max(self.ranks) + 1)]
        self.bytes_of = pa.array(texts, pa.binary())
        self._cache: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a byte string: again and again the neighbours of the smallest joint rank become one, the leftmost of equals.

        A part is known by its first byte's place; end[i] is the place of the part after it, before[i] that of the part
        before. The heap's numbers hold the joint rank, the left part and the end of the right one.
        """
        n, rank = len(piece), self.rank_of.get
        bits = n.bit_length()
        low, both = (1 << bits) - 1, 2 * bits
        end, before = [*range(1, n + 1), -1], list(range(-1, n))
        ids = [self.single[b] for b in piece]
        of_pair = self.pair
        heap = [r << both | i << bits | i + 2 for i, (a, b) in enumerate(itertools.pairwise(piece)) if (r := of_pair[a << 8 | b]) >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, stop = entry >> bits & low, entry & low
            middle = end[i]
            if end[middle] != stop:  # one of the two has been joined to another since
                continue
            end[i], end[middle], ids[i] = stop, n, entry >> both
            before[stop] = i
            if stop < n:
                after = end[stop]
                if (r := rank(piece[i:after])) is not None:
                    push(heap, r << both | i << bits | after)
            j = before[i]
            if j >= 0 and (r := rank(piece[j:stop])) is not None:
                push(heap, r << both | j << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return tuple(out)

    def fresh(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: the perfect hash's answer, or else the merge's."""
        piece = word.encode("utf-8", "surrogatepass")
        found = self.hash.find(piece)
        return (self.ranks[found],) if found >= 0 else self.merge(piece)

    def word(self, word: str) -> tuple[int, ...]:
        """As fresh; the ids of short pre-tokens are kept, and a full store makes way by generations."""
        ids = self._cache.get(word)
        if ids is not None:
            return ids
        ids = self._older.get(word)
        if ids is None:
            ids = self.fresh(word)
        if len(word) <= CACHE_CHARS:
            if len(self._cache) >= CACHE_WORDS:
                self._older, self._cache = self._cache, {}
            self._cache[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.splitter.words(text or "") for i in self.word(w)]

    def decode(self, ids) -> bytes:
        return b"".join([self.token_of[i] for i in ids])


def lay_out(words: list[str], ids_of: Callable[[str], Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a list of words, one after the other, and where each word's ids end; ids_of is asked once a distinct word."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    coded = pa.array(words, pa.string()).dictionary_encode()
    found = [ids_of(w) for w in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, found), np.int64, len(found))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(list(itertools.chain.from_iterable(found)), pa.int32()))
    codes = coded.indices.to_numpy()
    return lists.take(coded.indices).flatten().to_numpy(), np.cumsum(size[codes])


def encoded(texts: list[str | None], parts: Callable[[str, int], Iterator[list[str]]], ids_of: Callable[[str], Sequence[int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, ids) for texts in order; a long text gives several parts one after the other."""
    rows: list[tuple[int, int]] = []
    words: list[str] = []
    for i, text in enumerate(texts):
        for part in parts(text or "", GROUP_WORDS):
            words += part
            rows.append((i, len(words)))
            if len(words) >= GROUP_WORDS:
                yield from _cut(rows, *lay_out(words, ids_of))
                rows, words = [], []
    yield from _cut(rows, *lay_out(words, ids_of))


def _cut(rows: list[tuple[int, int]], ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    ends = np.append(0, ends)
    start = 0
    for i, stop in rows:
        yield i, ids[ends[start] : ends[stop]]
        start = stop


def pieces(table: pa.Array, ids: np.ndarray) -> memoryview:
    """The byte strings of the ids, joined."""
    if not len(ids):
        return memoryview(b"")
    found = table.take(pa.array(ids))
    where = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, found.offset * 4)
    return memoryview(found.buffers()[2])[where[0] : where[-1]]


def bytes_of_symbols() -> dict[str, int]:
    """The byte that each of the 256 symbols of a byte-level vocabulary file stands for: printable ones for themselves, the rest in turn from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a local file of ranks (.tiktoken) or of a byte-level tokenizer (.json), without special tokens."""
    with open(path, "rb") as f:
        data = f.read()
    if not path.endswith(".json"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    spec, byte = json.loads(data), bytes_of_symbols()
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes([byte[c] for c in t]): i for t, i in spec["model"]["vocab"].items() if t not in special}


@lru_cache(4)
def load(path: str, pattern: str) -> ByteBPE:
    """The encoder of a local file, one for each worker process."""
    return ByteBPE(read_ranks(path), pattern)


def rows(docs: DataFrame) -> DataFrame:
    """doc_id as a whole number (null where it is none) and text."""
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small(batches, size: int = 256):
    """Arrow batches in slices of at most `size` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids array<int>, decoded binary; one row per input row.

    Null and empty texts give no ids and no bytes. Rows are independent, repeated ones give equal rows, other columns are
    ignored. A doc_id that is no whole number is null in the result. The file must be at the same path on every machine.
    """

    def run(batches):
        model = load(path, pattern)
        for batch in small(batches):
            ids: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for i, found in encoded(batch.column(1).to_pylist(), model.splitter.parts, model.word):
                ids[i] += found.tolist()
            columns = [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(model.decode, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode_documents, with SHA-256 digests: of the ids as little-endian unsigned 32-bit integers, and of the decoded bytes."""

    def run(batches):
        model = load(path, pattern)
        for batch in small(batches):
            count = [0] * batch.num_rows
            of_ids, of_text = [[hashlib.sha256() for _ in count] for _ in range(2)]
            for i, found in encoded(batch.column(1).to_pylist(), model.splitter.parts, model.word):
                count[i] += len(found)
                of_ids[i].update(found.astype("<u4").tobytes())
                of_text[i].update(pieces(model.bytes_of, found))
            columns = [batch.column(0), pa.array(count, pa.int64())] + [pa.array([d.hexdigest() for d in side], pa.string()) for side in (of_ids, of_text)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
