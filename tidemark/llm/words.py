"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on together; bounds the memory of one task.
SLAB = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OF_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    got = _POWERS.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, SLAB + SLAB // 4), base, np.uint64)
        got[0] = 1
        _POWERS[name] = got = np.multiply.accumulate(got)
    return got[:n]


def words(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each run of bytes without ASCII white space."""
    found, at = [], 0
    while at < len(blob):
        stop = min(len(blob), at + SLAB)
        if stop < len(blob):  # not inside a word
            tail = np.flatnonzero(_SPACE[np.frombuffer(blob, np.uint8, stop - at, at)])
            if len(tail):
                stop = at + int(tail[-1]) + 1
            else:
                ahead = np.flatnonzero(_SPACE[np.frombuffer(blob, np.uint8, len(blob) - stop, stop)])
                stop = stop + int(ahead[0]) if len(ahead) else len(blob)
        data = np.frombuffer(blob, np.uint8, stop - at, at)
        solid = np.zeros(len(data) + 2, np.int8)
        solid[1:-1] = ~_SPACE[data]
        edges = np.diff(solid)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * _powers("up", _MULTIPLIER, len(data)), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(data) + 1)[starts])
        found.append((starts + at, ends + at, hashes))
        at = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def slabs(texts: list[str | None], size: int = SLAB) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 in lower case, null as empty, in consecutive lists of about ``size`` bytes; with the index of the first."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        data = text.lower().encode("utf-8", "replace") if isinstance(text, str) else b""
        if held and total + len(data) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(data)
        total += len(data)
    if held:
        yield first, held


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """For all words of all texts: index of the text, start and end in the joined bytes, hash."""
    blob = b"\n".join(texts)
    ends_of = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    starts, ends, hashes = words(blob)
    return np.searchsorted(ends_of, starts, side="right"), starts, ends, hashes, blob


def shingles(doc: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``size`` words; a shorter text is one shingle as a whole."""
    if not len(doc):
        return doc, hashes
    counts = np.bincount(doc)
    length = np.minimum(counts, size)[doc]
    left = np.cumsum(counts)[doc] - np.arange(len(doc))
    at = np.flatnonzero(left >= length)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        more = length[at] > k
        total[more] = total[more] * np.uint64(0x2545F4914F6CDD1D) + hashes[at[more] + k]
    return doc[at], mix(total)


def bags(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count): each text's multiset of shingles, ordered by text."""
    doc, hashes = shingles(*(x for i, x in enumerate(words_of(texts)) if i in (0, 3)), size)
    if not len(doc):
        return doc, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])
    return doc[first], hashes[first], np.diff(np.r_[first, len(doc)])
