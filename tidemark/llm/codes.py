"""Vector code compression: product quantisation in whole numbers, whose nearest entries are found by LAESA.

Components become floor(256 * x) and vectors are cut into ``PARTS`` equal parts, each with a
codebook of ``ENTRIES`` entries.  Each round assigns every part to its nearest entry and moves
the entries to the means.  The distances of all parts to a few fixed pivots are computed once
and kept with the vectors; in each round only those of the entries to the pivots are new.  By
the triangle inequality no entry is nearer to a part than the difference of their distances
to any pivot: a part's entries are tried in the order of that bound, with squared distances
in whole numbers, until no bound is below the best one found.

Sums and counts are added in each task and then by (part, entry), so that a fixed number of
rows reaches the driver, which computes the new entries.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so
are empty ones and those of another length than most (the longer of equally many); that length
has to be a multiple of ``PARTS``.  Whole numbers beyond +-``LARGEST`` are cut off there, which keeps
sums of squares within 64 bits.  A null id comes after all others, rows of one id in the order of
their vectors; with fewer rows than entries a codebook has as many entries as there are rows;
rows may repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 3
SCALE = 256
LARGEST = 1 << 26
#: Parts that are compared with all entries at once.
BLOCK = 4096
#: Up to so many labels, their sums are broadcast.
BROADCAST_LABELS = 100_000
#: By how much a bound, computed in floating point, may be too large.
SLACK = 1e-6


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ``x``, the vector in whole numbers, of the rows that take part; ``vectors`` has (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    cut = lambda v: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v * SCALE))
    rows = rows.where(sound).select("vec_id", "label", F.transform("e", lambda v: F.floor(cut(v)).cast("long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    length = sizes[0].n if sizes else PARTS
    if length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} equal parts")
    return rows.where(F.size("x") == length)


def pivots_of(books: np.ndarray) -> np.ndarray:
    """For each part, up to PIVOTS of its first entries that are far from one another: the first, then always that farthest from those chosen."""
    chosen = []
    for book in books:
        at = [0]
        far = ((book - book[0]) ** 2).sum(1)
        for _ in range(min(PIVOTS, len(book)) - 1):
            at.append(int(np.argmax(far)))
            far = np.minimum(far, ((book - book[at[-1]]) ** 2).sum(1))
        chosen.append(book[at])
    return np.stack(chosen)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of points (n, size) to pivots (m, size)."""
    return np.sqrt(((points[:, None, :] - pivots[None, :, :]) ** 2).sum(2).astype(np.float64))


def assign(points: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, book_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` for each point, the lowest of equally near ones, and its squared distance."""
    bound = np.zeros((len(points), len(book)))
    for p in range(book_to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - book_to_pivots[None, :, p]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1) * (1 - SLACK) - SLACK
    best, nearest = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)
    open_ = np.arange(len(points))
    for k in range(len(book)):
        if k:
            floor = np.maximum(bound[open_, k], 0)
            open_ = open_[floor * floor <= best[open_]]
            if not len(open_):
                break
        entry = order[open_, k]
        gap = points[open_] - book[entry]
        d = np.einsum("ij,ij->i", gap, gap)
        better = (d < best[open_]) | ((d == best[open_]) & (entry < nearest[open_]))
        best[open_[better]], nearest[open_[better]] = d[better], entry[better]
    return nearest, best


def _codes(x: np.ndarray, to_pivots: np.ndarray, books: np.ndarray, book_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (n, PARTS) and errors of vectors (n, PARTS, size)."""
    codes, errors = np.zeros((len(x), PARTS), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        for part in range(PARTS):
            some = slice(at, at + BLOCK)
            codes[some, part], d = assign(x[some, part], to_pivots[some, part], books[part], book_to_pivots[part])
            errors[some] += d
    return codes, errors


def _arrays(batch: pd.DataFrame, size: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(batch["x"]), np.int64).reshape(len(batch), PARTS, size)
    return x, np.frombuffer(b"".join(batch["to_pivots"]), np.float64).reshape(len(batch), PARTS, pivots)


def prepared(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id and label with the vector and its parts' distances to the pivots, as bytes."""
    size = pivots.shape[2]

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_list()).astype(np.int64).reshape(len(batch), PARTS, size) if len(batch) else np.zeros((0, PARTS, size), np.int64)
            far = np.stack([distances(x[:, part], pivots[part]) for part in range(PARTS)], 1)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "x": [v.tobytes() for v in x], "to_pivots": [v.tobytes() for v in far]})

    named = rows.select(F.col("vec_id").cast("string"), F.col("label").cast("string"), "x")  # as text, since pandas has no null integers
    return named.mapInPandas(prepare, "vec_id string, label string, x binary, to_pivots binary")


def moved(table: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry at the mean of its parts, rounded down; unused ones stay."""
    size = books.shape[2]
    near = np.stack([distances(books[part], pivots[part]) for part in range(PARTS)])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((PARTS, books.shape[1], size), np.int64), np.zeros((PARTS, books.shape[1]), np.int64)
        for batch in batches:
            x, to_pivots = _arrays(batch, size, pivots.shape[1])
            codes, _ = _codes(x, to_pivots, books, near)
            for part in range(PARTS):
                np.add.at(sums[part], codes[:, part], x[:, part])
                counts[part] += np.bincount(codes[:, part], minlength=books.shape[1])
        part, entry = np.nonzero(counts)
        for at in range(size):
            yield pd.DataFrame({"part": part, "entry": entry, "at": at, "sum": sums[part, entry, at], "n": counts[part, entry]})

    found = table.mapInPandas(add, "part int, entry int, at int, sum long, n long").groupBy("part", "entry", "at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    out = books.copy()
    for row in found.collect():  # one row for each component of each entry
        out[row.part, row.entry, row.at] = row["sum"] // row.n
    return out


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part; ``vectors`` has (vec_id, embedding, label)."""
    rows = whole(vectors)
    first = rows.where("vec_id is not null").orderBy("vec_id", "x").limit(ENTRIES).collect()
    if len(first) < ENTRIES:
        first += rows.where("vec_id is null").orderBy("x").limit(ENTRIES - len(first)).collect()
    if not first:
        empty = vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        return empty
    start = np.array([r.x for r in first], np.int64)
    books = start.reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy()
    pivots = pivots_of(books)
    table = saved(prepared(rows, pivots))
    for _ in range(rounds):
        books = moved(table, books, pivots)
    near = np.stack([distances(books[part], pivots[part]) for part in range(PARTS)])
    size = books.shape[2]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, to_pivots = _arrays(batch, size, pivots.shape[1])
            codes, errors = _codes(x, to_pivots, books, near)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "code": [bytes(c).hex() for c in codes.astype(np.uint8)], "error": errors})

    coded = saved(table.mapInPandas(code, "vec_id string, label string, code string, error long"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    sums = by_label.withColumnRenamed("label", "of")
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return joined.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _nearest(n: int) -> str:
    """SQL: each part's nearest entry of the codebooks ``book{n}``."""
    return f"""
  near{n} as (
    select vec_id, part, arg_min(entry, (d, entry)) as entry, min(d) as d
    from (select p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from parts p join book{n} b using (part))
    group by vec_id, part)"""


def _next(n: int) -> str:
    return f"""
  {_nearest(n)},
  sums{n} as (
    select part, entry, pos, cast(floor(sum(v)::double / count(*)) as bigint) as v
    from (select part, n.entry, unnest(range(1, len(x) + 1)) as pos, unnest(x) as v from parts join near{n} n using (vec_id, part)) group by part, entry, pos),
  moved{n} as (select part, entry, list(v order by pos) as x from sums{n} group by part, entry),
  book{n + 1} as (select part, entry, coalesce(m.x, b.x) as x from book{n} b left join moved{n} m using (part, entry))"""


#: Ids are distinct and all vectors of one length in the tables.
ORACLE_SQL = f"""
with
  kept as (
    select vec_id, label, list_transform(embedding, lambda v: cast(floor({SCALE} * v::double) as bigint)) as x
    from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
  parts as (select vec_id, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] as x from kept, (select unnest(range({PARTS})) as part)),
  firsts as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {ENTRIES}),
  book0 as (select part, entry, x from parts join firsts using (vec_id)),
  {", ".join(_next(n) for n in range(ROUNDS))},
  {_nearest(ROUNDS)},
  digest as (
    select sha256(string_agg(v, ',' order by part, entry, pos)) as codebooks_sha256
    from (select part, entry, unnest(range(1, len(x) + 1)) as pos, unnest(x)::varchar as v from book{ROUNDS})),
  coded as (select vec_id, string_agg(lower(printf('%02x', entry)), '' order by part) as code, cast(sum(d) as bigint) as error from near{ROUNDS} group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (vec_id), digest
"""
