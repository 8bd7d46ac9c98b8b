"""Word shingles and SuperMinHash signatures, computed for batches of documents with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from codexlake.llm.common import mix64, word_hashes

#: Odd multipliers of the five words of a shingle.
_POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Elements that one pass over a batch holds; longer documents go through in pieces.
PASS = 1 << 16


def shingle_sets(col: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text of a column, A-Z lower-cased.

    Fewer words than k: the whole sequence is one shingle. Null or no words: empty.
    """
    words, ends = word_hashes(col)
    out: list[np.ndarray] = []
    n = len(words)
    with np.errstate(over="ignore"):
        full = np.full(max(0, n - k + 1), np.uint64(k), np.uint64)
        for i in range(k):
            full += words[i : n - k + 1 + i] * _POSITION[i] if n >= k else 0
        full = mix64(full)
        start = 0
        for end in ends.tolist():
            if end - start >= k:
                part = np.sort(full[start : end - k + 1])
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                out.append(part[keep])
            elif end > start:
                one = np.full(1, np.uint64(end - start), np.uint64)
                for i in range(end - start):
                    one += words[start + i] * _POSITION[i]
                out.append(mix64(one))
            else:
                out.append(np.empty(0, np.uint64))
            start = end
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same, len(both) - same


def _absorb(h: np.ndarray, elements: np.ndarray, owner: np.ndarray, m: int) -> None:
    """Lower h (documents x m) by the elements, whose documents owner names.

    Level j gives each element the value j + r at the j-th place of its own random permutation of the m slots
    (drawn by Fisher-Yates swaps), so the ranks of an element are correlated over the slots. A document stops as
    soon as no slot holds more than j: later levels only give larger values.
    """
    flat = h.reshape(-1)
    step = 0x9E3779B97F4A7C15
    seed = elements
    drawn: list[np.ndarray] = []  # the places drawn at levels 0 and 1
    places = None
    with np.errstate(over="ignore"):
        for j in range(m):
            going = h.max(axis=1) > j
            if not going.all():
                keep = going[owner]
                if not keep.any():
                    return
                seed, owner, drawn = seed[keep], owner[keep], [d[keep] for d in drawn]
                places = places[keep] if places is not None else None
            x = mix64(seed + np.uint64((2 * j + 1) * step & 0xFFFFFFFFFFFFFFFF))
            at = (((x >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
            if j == 0:
                slot = at  # the permutation is still the identity
            elif j == 1:
                slot = np.where(at == drawn[0], 0, at)  # only the first swap has been made
            else:
                rows = np.arange(len(seed))
                if places is None:
                    places = np.empty((len(seed), m), np.uint8)
                    places[:] = np.arange(m, dtype=np.uint8)
                    places[rows, drawn[0]] = 0
                    places[rows, drawn[1]] = places[rows, 1]
                slot = places[rows, at].astype(np.int64)
                places[rows, at] = places[rows, j]
            np.minimum.at(flat, owner * m + slot, (x & np.uint64(0xFFFFFFFF)) / 4294967296.0 + j)
            if j < 2:
                drawn.append(at)


def signatures(sets: list[np.ndarray], m: int = 128) -> np.ndarray:
    """SuperMinHash signatures (len(sets) x m, float64); an empty set keeps infinities."""
    h = np.full((len(sets), m), np.inf)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= PASS):
            total += len(sets[stop])
            stop += 1
        part = sets[start:stop]
        if total:
            owner = np.repeat(np.arange(stop - start), [len(s) for s in part])
            flat = np.concatenate(part)
            for i in range(0, len(flat), PASS):
                _absorb(h[start:stop], flat[i : i + PASS], owner[i : i + PASS], m)
        start = stop
    return h


def band_keys(h: np.ndarray, rows: int = 4) -> np.ndarray:
    """64-bit keys of consecutive bands of so many rows (documents x m / rows, int64)."""
    n, m = h.shape
    bits = h.view(np.uint64).reshape(n, m // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(1, m // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (n, m // rows))
        for i in range(rows):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, i])
    return key.view(np.int64)
