"""Resampling to a target distribution: weights scored through an array of gains, and the best drawn by a parallel sort.

A text is lower-cased in A-Z and cut into words; its features are its words, repeats counted,
and each is dealt to one of ``BUCKETS`` buckets by its CRC.  The gain of a bucket says how much
more often the target has its features than the corpus; the weight of a document is the mean
gain of its features, and its score adds Gumbel noise that depends on its id alone.  Of the
documents with enough words, those of the highest scores are drawn, which is a draw
without replacement in proportion to exp(weight / 1000).

Counts are added in each task first and then by bucket, so that only ``BUCKETS`` numbers
reach the driver, whatever the size of the corpus.  The sort is one by regular sampling:

1. every partition is a run, sorted on its own; each gives keys at regular steps;
2. the sampled keys, at most ``MAX_RUNS * RUN_SAMPLES``, are sorted and give the splitters;
3. rows are counted by the segments between splitters; the sums before each segment say at
   which rank it begins, and from which segment on nothing is drawn;
4. the other segments alone are exchanged, each is sorted where it arrives, and a row's rank is
   where its segment begins plus its place in it.

Keys are (score, id, features, place in the table), so they are unique, and rows of one id with a
third of the table are dealt to many segments like any others.

Defined results: null, empty and wordless texts have no features and weight 0 and are never
drawn; a null id is hashed as an empty one and comes last among equal scores; repeated rows are
scored and drawn one by one; without target texts all gains come from the corpus alone; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

BUCKETS = 10_000
SEED = 2024
MIN_FEATURES = 20
#: Per cent of the documents with enough words that are drawn.
DRAWN = 10
#: Runs are partitions, joined without a shuffle if there are more than so many.
MAX_RUNS = 10_000
#: Keys that each run gives.
RUN_SAMPLES = 100
#: Bytes of text that are worked on together.
SLAB = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of the bytes."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    order = order[int(np.count_nonzero(lengths > LONG_WORD)) :]
    at, left = starts[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # the spans longer than k, which come first
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out[order] = ~crc
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def buckets_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of the features of all texts, in slabs that end between words."""
    blob = b"\n".join(t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts).translate(_LOWER)
    ends_of = np.cumsum(np.fromiter((len(t.encode("utf-8", "replace")) if isinstance(t, str) else 0 for t in texts), np.int64, len(texts)) + 1)
    whole, at = np.frombuffer(blob, np.uint8), 0
    while at < len(whole):
        stop = min(len(whole), at + SLAB)
        while stop < len(whole) and _IN_WORD[whole[stop - 1]]:  # to the next byte outside words
            ahead = np.flatnonzero(~_IN_WORD[whole[stop : stop + SLAB]])
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(len(whole), stop + SLAB)
        part = whole[at:stop]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = _IN_WORD[part]
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        yield np.searchsorted(ends_of, starts + at, side="right"), (crc32_of(part, starts, ends) % np.uint32(BUCKETS)).astype(np.int64)
        at = stop


def feature_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts each bucket holds; ``texts`` has one column."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets in buckets_of(batch.iloc[:, 0].tolist()):
                total += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of its smoothed share in the target over that in the corpus, rounded down."""
    s, t, all_s, all_t = corpus.tolist(), target.tolist(), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight of every row of ``docs`` (doc_id, text)."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for text, buckets in buckets_of(batch["text"].tolist()):
                n += np.bincount(text, minlength=len(batch))
                np.add.at(total, text, gain[buckets])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)})

    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))  # as text, since pandas has no null integers
    return ids.mapInPandas(scored, "doc_id string, n_features long, weight long").withColumn("doc_id", F.col("doc_id").cast("long"))


def score(seed: int) -> Column:
    """The weight with Gumbel noise from a hash of the seed and the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


#: What rows are sorted by, ascending: the score negated, then nulls after all ids.
KEY = ["k_score", "k_null", "k_id", "k_features", "k_place"]


def _keyed(scored: DataFrame) -> DataFrame:
    """With the columns of the key; ``scored`` has to be a saved table, as a row's place is part of it."""
    doc_id = F.col("doc_id")
    keys = [-F.col("score"), doc_id.isNull().cast("long"), F.coalesce(doc_id, F.lit(0).cast("long")), F.col("n_features"), F.monotonically_increasing_id()]
    return scored.select("*", *(key.alias(name) for key, name in zip(keys, KEY)))


def _lexsort(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows.T[::-1])


def splitters(keyed: DataFrame, segments: int) -> np.ndarray:
    """Keys that cut all rows into about equal segments: each run is sorted and sampled at regular steps, and so are the samples."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = [batch.to_numpy(np.int64) for batch in batches]  # the keys of one partition
        rows = np.concatenate(run) if run else np.zeros((0, len(KEY)), np.int64)
        rows = rows[_lexsort(rows)]
        n = min(RUN_SAMPLES, len(rows))
        at = (np.arange(n) * 2 + 1) * len(rows) // (2 * n) if n else []
        yield pd.DataFrame(rows[at], columns=KEY).assign(stands_for=len(rows) / max(n, 1))

    schema = ", ".join(f"{k} long" for k in KEY) + ", stands_for double"
    found = keyed.select(*KEY).coalesce(MAX_RUNS).mapInPandas(sample, schema).toPandas()  # at most MAX_RUNS * RUN_SAMPLES rows
    keys = found[KEY].to_numpy(np.int64)
    order = _lexsort(keys)
    upto = np.cumsum(found["stands_for"].to_numpy()[order])
    steps = np.arange(1, segments) * (upto[-1] / segments) if len(upto) else np.zeros(0)
    return keys[order][np.unique(np.minimum(np.searchsorted(upto, steps), max(len(upto) - 1, 0)))] if len(upto) else keys


def with_segments(keyed: DataFrame, cuts: np.ndarray) -> DataFrame:
    """With ``segment``: how many splitters come before the row's key or equal it."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = np.concatenate([cuts, batch[KEY].to_numpy(np.int64)])
            order = _lexsort(both)
            before = np.cumsum(order < len(cuts))
            segment = np.empty(len(both), np.int64)
            segment[order] = before
            yield batch.assign(segment=segment[len(cuts) :])

    return keyed.mapInPandas(deal, ", ".join(f"{c} long" for c in [*keyed.columns, "segment"]))


def ranked(scored: DataFrame, drawn: int, segments: int) -> DataFrame:
    """doc_id, n_features, weight, score and ``rank`` (from 1 to ``drawn``, null for all others) of every row of the saved table ``scored``."""
    enough = F.col("n_features") >= MIN_FEATURES
    keyed = _keyed(scored).drop("doc_id")
    chosen = keyed.where(enough)
    cuts = splitters(chosen, segments)
    dealt = saved(with_segments(chosen, cuts))
    sizes = np.zeros(len(cuts) + 1, np.int64)
    for row in dealt.groupBy("segment").count().collect():  # one row for each segment
        sizes[row.segment] = row["count"]
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    last = int(np.searchsorted(begins, drawn))  # the segments before this one begin among those drawn

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen = -1, 0
        for batch in batches:
            segment = batch.pop("segment").to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, np.int64)
            rank = np.empty(len(segment), np.int64)
            for a, b in zip(starts, [*starts[1:], len(segment)]):
                if segment[a] != now:
                    now, seen = int(segment[a]), 0
                rank[a:b] = begins[now] + seen + 1 + np.arange(b - a)
                seen += b - a
            yield batch.assign(rank=rank)

    columns = ["n_features", "weight", "score", *KEY]
    exchanged = dealt.where(F.col("segment") < last).select(*columns, "segment").repartitionById(max(1, last), F.col("segment").cast("int")).sortWithinPartitions("segment", *KEY)
    placed = exchanged.mapInPandas(place, ", ".join(f"{c} long" for c in [*columns, "rank"]))
    rest = dealt.where(F.col("segment") >= last).select(*columns).union(keyed.where(~enough).select(*columns)).withColumn("rank", F.lit(None).cast("long"))
    doc_id = F.when(F.col("k_null") == 0, F.col("k_id"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return placed.union(rest).select(doc_id.alias("doc_id"), "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), towards the texts of ``target``."""
    gain = gains(feature_counts(docs.select("text")), feature_counts(target.select("text")))
    scored = saved(weigh(docs, gain).withColumn("score", score(seed)))
    drawn = percent * scored.where(F.col("n_features") >= MIN_FEATURES).count() // 100
    return ranked(scored, drawn, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL_WORDS = f"unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word"

ORACLE_SQL = f"""
with
  crc_table as (
    select list(c order by n) as t from (
      select n, list_reduce(list_prepend(n, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) as c from range(256) r(n))),
  doc_words as (select doc_id, {_SQL_WORDS} from documents),
  target_words as (select {_SQL_WORDS} from benchmark),
  bytes as (
    select word, list_transform(range(1, length(code) // 2 + 1), lambda i: ('0x' || substr(code, 2 * i - 1, 2))::bigint) as b
    from (select word, hex(encode(word)) as code from (select word from doc_words union select word from target_words))),
  bucket_of as (
    select word, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::bigint) % {BUCKETS} as bucket
    from bytes, crc_table),
  corpus as (select bucket, count(*) as s from doc_words join bucket_of using (word) group by bucket),
  target as (select bucket, count(*) as t from target_words join bucket_of using (word) group by bucket),
  sums as (select (select count(*) from doc_words)::double as all_s, (select count(*) from target_words)::double as all_t),
  gains as (
    select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + {BUCKETS}) / ((coalesce(s, 0) + 1) * (all_t + {BUCKETS})))) as bigint) as gain
    from corpus full join target using (bucket), sums),
  weights as (select doc_id, count(*) as n, cast(floor(sum(gain)::double / count(*)) as bigint) as w from doc_words join bucket_of using (word) join gains using (bucket) group by doc_id),
  scored as (
    select d.doc_id, coalesce(n, 0) as n_features, coalesce(w, 0) as weight,
      coalesce(w, 0) + cast(floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || d.doc_id), 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as score
    from documents d left join weights using (doc_id)),
  drawn as (
    select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= {MIN_FEATURES}
    qualify rank <= {DRAWN} * count(*) over () // 100)
select doc_id, n_features, weight, score, rank from scored left join drawn using (doc_id)
"""
