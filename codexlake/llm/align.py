"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and links between them.

A transducer reads the two token sequences of a text. Its state is the suffix that dangles: which side leads, and the
bytes of its last token that the other side has not matched yet. It always reads the next token of the side that is
behind; a token that agrees with the dangling bytes is linked with the last token of the other side, because both cover
its first bytes. Transitions are memoised by residual and next token; an empty residual closes a group.

How often each pair of ids is linked in the corpus is counted by blocks of documents: a block's distinct pairs are
shuffled once, not every document's, joined with the totals and brought back to the block's documents.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm import byte_bpe, sentencepiece_bpe
from codexlake.llm.common import written

#: Links after which a block is closed (a document is never cut), transitions and units that are kept in memory.
BLOCK_LINKS, MOST_STEPS, CACHE_UNITS = 1_000_000, 1_000_000, 250_000
#: Texts read at once.
GROUP_ROWS, GROUP_CHARS = 1000, 1 << 20
_DOC = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, times array<int>"
_BLOCK = "pairs array<long>, counts array<long>"


class Transducer:
    """State 0: no bytes dangle; odd states: the first side leads, even ones: the second."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.first, self.second = first, second
        self.forget()

    def forget(self) -> None:
        self.step: dict[int, int] = {}
        self.whole: dict[int, str] = {}  # link -> group, where two tokens of equal bytes are a group: two transitions in one
        self.residual: list[bytes] = [b"", b""]
        self.state: dict[tuple[bool, bytes], int] = {}

    def _number(self, first_leads: bool, residual: bytes) -> int:
        if not residual:
            return 0
        found = self.state.get((first_leads, residual))
        if found is None:
            found = len(self.residual) // 2 * 2 + first_leads
            self.residual += [residual, residual]
            self.state[first_leads, residual] = found
        return found

    def _transition(self, state: int, token: int) -> int:
        """The state after the next token of the side that is behind; -1 if it contradicts the dangling bytes."""
        left, read = self.residual[state], (self.second if state & 1 else self.first)[token]
        if len(read) <= len(left):
            to = self._number(bool(state & 1), left[len(read) :]) if left.startswith(read) else -1
        else:
            to = self._number(not state & 1, read[len(left) :]) if read.startswith(left) else -1
        self.step[state << 20 | token] = to
        return to

    def align(self, a_ids: list[int], b_ids: list[int]) -> tuple[list[str], list[int]] | None:
        """(the groups as texts 'a1,a2|b1', links as first id << 20 | second id), or None if the two sides' bytes differ."""
        if len(self.step) > MOST_STEPS:
            self.forget()
        step, whole = self.step.get, self.whole.get
        groups, links = [], []
        i = j = state = 0
        open_a = open_b = 0
        n_a, n_b = len(a_ids), len(b_ids)
        a = b = 0
        while True:
            if state & 1:  # the first side leads
                if j == n_b:
                    return None
                b = b_ids[j]
                j += 1
                links.append(a << 20 | b)
                to = step(state << 20 | b)
                if to is None:
                    to = self._transition(state, b)
            elif i < n_a:
                a = a_ids[i]
                i += 1
                if state:
                    links.append(a << 20 | b)
                elif j < n_b and (group := whole(link := a << 20 | b_ids[j])) is not None:
                    j += 1
                    links.append(link)
                    groups.append(group)
                    open_a, open_b = i, j
                    continue
                to = step(state << 20 | a)
                if to is None:
                    to = self._transition(state, a)
            elif state or j < n_b:
                return None
            else:
                return groups, links
            if to <= 0:
                if to < 0:
                    return None
                group = ",".join(map(str, a_ids[open_a:i])) + "|" + ",".join(map(str, b_ids[open_b:j]))
                if i - open_a == 1 == j - open_b:
                    self.whole[a << 20 | b] = group
                groups.append(group)
                open_a, open_b = i, j
            state = to


class Pair:
    """A byte-level vocabulary reading space + text, and pieces reading text (they add the space).

    Both sides' cuts (pre-tokens, runs of marks with what follows) fall together after nearly every word, so a text is read
    unit by unit: what lies between two common cuts. A group of texts' new units are encoded by the tokenizers' libraries
    at once; the transducer starts each unit with nothing dangling. What it makes of short ones is kept, by generations.
    """

    def __init__(self, byte_level: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        ranks = byte_bpe.read_ranks(byte_level)
        self.splitter = byte_bpe.Splitter(pattern)
        self.first = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of_rank = {i: t for t, i in ranks.items()}
        piece = lambda i, p: bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(sentencepiece_bpe.MARK, " ").encode()
        self.transducer = Transducer([of_rank.get(i, b"") for i in range(max(of_rank) + 1)], [piece(i, self.second.id_to_piece(i)) for i in range(len(self.second))])
        self._cache: dict[str | tuple, tuple] = {}
        self._older: dict[str | tuple, tuple] = {}

    def units(self, text: str):
        """The text's units: one pre-token of space + text, or a tuple of several."""
        words = itertools.chain.from_iterable(self.splitter.parts(" " + text, byte_bpe.GROUP_WORDS))
        unit, ahead = None, 0  # ahead: characters of the unit that no segment has covered yet
        for segment in sentencepiece_bpe.segments(text):
            ahead -= len(segment)
            if unit is None:
                word = next(words)
                ahead += len(word)
                if not ahead:
                    yield word
                    continue
                unit = [word]
            while ahead < 0:
                word = next(words)
                ahead += len(word)
                unit.append(word)
            if not ahead:
                yield tuple(unit)
                unit = None

    def _read(self, units: list) -> list[tuple]:
        """(tokens of either side, groups, the groups' text, links as 64-bit integers' bytes) of each unit; () if the sides' bytes differ."""
        encode, align = self.first._encode_single_piece, self.transducer.align
        a = [encode(u) if isinstance(u, str) else [i for w in u for i in encode(w)] for u in units]
        b = self.second.encode([u[1:] if isinstance(u, str) else "".join(u)[1:] for u in units], num_threads=1)
        if " " in units:  # the library adds no space to an empty text
            b[units.index(" ")] = [self.second.piece_to_id(sentencepiece_bpe.MARK)]
        out = []
        for first, second, found in zip(a, b, map(align, a, b)):
            out.append(() if found is None else (len(first), len(second), len(found[0]), ";".join(found[0]), array("q", found[1]).tobytes()))
        return out

    def _known(self, units: set) -> dict:
        """unit -> what _read gives, for a group of texts' units."""
        here, fresh = {}, []
        for u in units:
            found = self._cache.get(u)
            if found is None:
                found = self._older.get(u)
                if found is None:
                    fresh.append(u)
                    continue
                self._keep(u, found)
            here[u] = found
        for u, found in zip(fresh, self._read(fresh)):
            here[u] = found
            self._keep(u, found)
        return here

    def _keep(self, unit, found: tuple) -> None:
        if (len(unit) if isinstance(unit, str) else sum(map(len, unit))) <= sentencepiece_bpe.CACHE_CHARS:
            if len(self._cache) >= CACHE_UNITS:
                self._older, self._cache = self._cache, {}
            self._cache[unit] = found

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, bytes]]:
        """As _read, of texts; all empty where there is no text or the two sides' bytes differ."""
        lists = [list(self.units(t)) if t else [] for t in texts]
        known = self._known(set(itertools.chain.from_iterable(lists))).__getitem__
        out = []
        for units in lists:
            found = list(map(known, units))
            if found and all(found):
                n_a, n_b, n_groups, groups, links = zip(*found)
                out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)))
            else:
                out.append((0, 0, 0, "", b""))
        return out


def _groups(batches):
    """(ids, texts) in groups of at most so many rows and about so many characters; a text leaves Arrow when its turn comes."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= GROUP_CHARS or len(ids) >= GROUP_ROWS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


@lru_cache(2)
def load(byte_level: str, pattern: str, pieces: str) -> Pair:
    return Pair(byte_level, pattern, pieces)


def _blocks(paths: tuple[str, str, str]):
    names = [x.split()[0] for x in f"{_DOC}, {_BLOCK}".split(", ")]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def block(number: int, rows: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
        pairs, at, count = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) for x in links])
        found = [np.unique(part, return_counts=True) for part in np.split(at, ends[:-1])]
        n = len(rows)
        columns = [pa.array([number] * (n + 1), pa.int64())] + [pa.array([*side, None]) for side in zip(*rows)]
        columns += [pa.array([*[f[k].astype(np.int32) for f in found], None], ints) for k in (0, 1)]
        columns += [pa.array([None] * n + [x], longs) for x in (pairs, count)]
        types = [pa.int64()] * 6 + [pa.string(), ints, ints, longs, longs]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names=names)

    def run(batches):
        both = load(*paths)
        number = TaskContext.get().partitionId() << 32
        rows, links, size = [], [], 0
        for ids, texts in _groups(batches):
            for doc_id, (n_a, n_b, n_groups, groups, found) in zip(ids, both.align(texts)):
                links.append(np.frombuffer(found, np.int64))
                rows.append((doc_id, n_a, n_b, n_groups, len(links[-1]), hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
                size += len(links[-1]) + 1
                if size >= BLOCK_LINKS:
                    yield block(number, rows, links)
                    number, rows, links, size = number + 1, [], [], 0
        if rows:
            yield block(number, rows, links)

    return run


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with n_best and count_sum, from the totals of the block's pairs."""
    size = max(pairs.num_rows, 1)
    total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = pairs.column("at").to_numpy()
    total[at], best[at] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
    links, times = docs.column("links").combine_chunks(), docs.column("times").combine_chunks()
    ends = np.append(0, np.cumsum(links.value_lengths().to_numpy()))
    at, times = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = [np.append(0, np.cumsum(of[at] * times)) for of in (best, total)]
    out = docs.drop_columns(["block", "links", "times"])
    for name, run in zip(("n_best", "count_sum"), sums):
        out = out.append_column(name, pa.array(run[ends[1:]] - run[ends[:-1]], pa.int64()))
    return out


def align_documents(docs: DataFrame, byte_level: str, pattern: str, pieces: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per input row.

    Null and empty texts, and those whose bytes the pieces change (a lower one eighth block in the text becomes a space),
    have zeros and an empty digest, and add nothing to the counts. Repeated rows count as often as they occur. Other
    columns are ignored; a doc_id that is no whole number is null in the result. Files: at the same paths on every machine.
    """
    found = written(byte_bpe.rows(docs).mapInArrow(_blocks((byte_level, pattern, pieces)), f"{_DOC}, {_BLOCK}"), "aligned")
    pairs = found.filter("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "p")).select("of", "at", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    highest = totals.groupBy(F.col("pair").bitwiseAND((1 << 20) - 1).alias("b")).agg(F.max("total").alias("highest"))
    judged = totals.join(highest, F.col("pair").bitwiseAND((1 << 20) - 1) == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    known = pairs.join(written(judged, "pair-totals"), "pair").select("of", "at", "total", "best")
    rows = found.filter("pairs IS NULL").drop("pairs", "counts")
    with_links = rows.filter("n_links > 0").groupBy("block").cogroup(known.groupBy("of"))
    out = with_links.applyInArrow(_sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    zero = F.lit(0).cast("long")
    out = out.unionByName(rows.filter("n_links = 0").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", zero.alias("n_best"), zero.alias("count_sum")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_groups(docs: DataFrame, byte_level: str, pattern: str, pieces: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, groups array<string>: each group as 'a1,a2|b1', ids of both sides in order."""

    def run(batches):
        both = load(byte_level, pattern, pieces)
        for ids, texts in _groups(batches):
            groups = [found[3].split(";") if found[3] else [] for found in both.align(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(groups, pa.list_(pa.string()))], names=["doc_id", "groups"])

    return byte_bpe.rows(docs).mapInArrow(run, "doc_id long, groups array<string>")


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
