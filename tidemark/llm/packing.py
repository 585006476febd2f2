"""Packing token sequences with Karmarkar-Karp multiway differencing.

``token_pieces`` cuts every document into full windows and, of the rest, parts, and keeps
only lengths and checksums, so the ids themselves are never shuffled.  ``pack`` deals
the pieces into shards of bounded expected size and balances each shard's pieces over
as few windows as hold them.

Defined results: a null text counts as empty and becomes one piece that holds only the
end id; repeated rows (also of one doc_id) are packed as often as they occur; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: What doesn't fill a window is cut into parts of this length, which even out better.
PART = 512
END_ID = 1
DOCUMENTS_PER_SHARD = 128
CACHED_CHUNKS = 250_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"

#: Texts with other characters, or with what may be a special token, go to the tokenizer whole.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-įı-ɏ]|<\\|")


class _Encoder(dict):
    """Ids (as bytes) of chunks between white space; the pre-tokenizer never joins across white space.

    Chunks seen lately are remembered: when there are too many, those not asked for since
    the last such time are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isalpha():  # one word of the pre-tokenizer
                word = chunk if chunk.isascii() else self.byte_level(chunk)[0][0]
                ids = array("I", [t.id for t in self.tokenize(word)]).tobytes()
            elif chunk[-1] in ".,|" and chunk[:-1].isalpha():
                ids = self[chunk[:-1]] + self[chunk[-1]]
            else:
                ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > CACHED_CHUNKS:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One per Python worker, since loading the vocabulary takes longer than a batch."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, part: int = PART, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length, and the CRC-32 of its ids."""

    end = array("I", [end_id]).tobytes()

    def cut(batches):
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            ids_of, starts, lengths, sums, totals = [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = memoryview((encode(text) if text else b"") + end)
                total = len(ids) // 4
                whole = total - total % window
                for start in (*range(0, whole, window), *range(whole, total, part)):
                    piece = ids[4 * start : 4 * (start + (window if start < whole else part))]
                    ids_of.append(doc_id)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
            yield pd.DataFrame({"doc_id": pd.Series(ids_of, dtype="Int64"), "start": starts, "length": lengths, "ids_crc32": sums, "doc_tokens": totals})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def balance(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Karmarkar-Karp: the window of each length, sums being as equal as differencing makes them.

    Every length starts as a partition whose other windows are empty.  The two partitions
    with the widest spreads are merged, the fullest windows of one onto the emptiest of the
    other, until one partition is left.
    """
    n = len(lengths)
    left, right = [np.zeros(n + 1, np.int64)], [np.zeros(n + 1, np.int64)]  # node 0 is empty, 1..n are the lengths
    made = n + 1
    heap = []
    for i, x in enumerate(lengths):
        nodes = np.zeros(windows, np.int64)
        nodes[0] = i + 1
        heap.append((-int(x), i, np.r_[int(x), np.zeros(windows - 1, np.int64)], nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        sums, other = a + b[::-1], b_nodes[::-1]
        nodes = np.maximum(a_nodes, other)
        both = np.flatnonzero((a_nodes > 0) & (other > 0))
        if len(both):
            left.append(a_nodes[both])
            right.append(other[both])
            nodes[both] = np.arange(made, made + len(both))
            made += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, nodes))
        serial += 1
    left, right = np.concatenate(left), np.concatenate(right)
    window_of = np.full(made, -1, np.int64)
    top = heap[0][3]
    window_of[top[top > 0]] = np.flatnonzero(top > 0)
    for node in range(made - 1, n, -1):  # a node is made after its parts
        if window_of[node] >= 0:
            window_of[left[node]] = window_of[right[node]] = window_of[node]
    return window_of[1 : n + 1]


def fill_windows(lengths: np.ndarray, window: int) -> np.ndarray:
    """Windows of all lengths; one more is taken whenever the fullest would exceed the capacity."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    windows = max(1, math.ceil(int(lengths.sum()) / window))
    while True:
        of = balance(lengths, windows)
        if np.bincount(of, weights=lengths).max() <= window:
            return of
        windows += 1


def pack(pieces: DataFrame, documents: int, window: int = WINDOW, documents_per_shard: int = DOCUMENTS_PER_SHARD) -> DataFrame:
    """Give every piece a sequence and an offset; offsets in a sequence are gapless from 0.

    ``documents`` is the number of documents behind the pieces, from which the number of shards follows.
    """
    shards = max(1, math.ceil(documents / documents_per_shard))

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "start"], ascending=False, ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        full = lengths >= window
        of = np.empty(len(pdf), np.int64)
        of[full] = np.arange(full.sum())
        of[~full] = full.sum() + fill_windows(lengths[~full], window)
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        first = np.r_[True, np.diff(of[order]) > 0] if len(of) else np.zeros(0, bool)
        base = np.maximum.accumulate(np.where(first, starts, 0))
        pdf = pdf.iloc[order]
        return pdf.assign(sequence_id=(int(key[0]) << 32) + of[order], offset=starts - base).drop(columns="shard")

    # The row number spreads pieces that are equal in all they say, as those of repeated rows.
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, window), docs.count(), window)
