"""Words of many texts as runs of letters, over arrays of code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np

from tidemark.llm.words import mix

#: Characters that are worked on together; bounds the memory of one task.
SLAB = 1 << 19

_STEP = 0x9E3779B97F4A7C15 | 1


@cache
def letters(digits: bool = False) -> np.ndarray:
    """For each code point, whether it is a letter or a mark (or a digit)."""
    kinds = "LMN" if digits else "LM"
    return np.fromiter((unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)), bool, 0x110000)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(2 * SLAB, _STEP, np.uint64), np.full(2 * SLAB, pow(_STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Runs(NamedTuple):
    """Words in one slab: code points, index of the text, start and end in the code points."""

    points: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self) -> np.ndarray:
        """Sums from which ``span_hash`` gets the hash of any span."""
        out = np.zeros(len(self.points) + 1, np.uint64)
        up = _powers()[0]
        step = len(up)
        for at in range(0, len(self.points), step):  # more than one round for a word longer than a slab only
            part = self.points[at : at + step]
            np.cumsum(mix(part.astype(np.uint64) + np.uint64(0x5851F42D)) * up[: len(part)], out=out[at + 1 : at + 1 + len(part)])
            out[at + 1 : at + 1 + len(part)] += out[at]
        return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _powers()[1]
    return mix((sums[end] - sums[start]) * down[start % len(down)])


def batches(texts: list[str | None], size: int = SLAB) -> Iterator[tuple[int, list[str]]]:
    """The texts in lower case, null as empty, in consecutive lists of about ``size`` characters; with the index of the first."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        text = text.lower() if isinstance(text, str) else ""
        if held and total + len(text) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(text)
        total += len(text)
    if held:
        yield first, held


def runs(texts: list[str], digits: bool = False) -> Iterator[Runs]:
    """All words of the texts, slab by slab; a slab ends between words."""
    is_letter = letters(digits)
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends_of = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    at = 0
    while at < len(points):
        stop = min(len(points), at + SLAB)
        while stop < len(points) and is_letter[points[stop - 1]] and is_letter[points[stop]]:
            stop += 1
        part = points[at:stop]
        solid = np.zeros(len(part) + 2, np.int8)
        solid[1:-1] = is_letter[part]
        edges = np.diff(solid)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        yield Runs(part, np.searchsorted(ends_of, start + at, side="right"), start, end)
        at = stop
