"""Approximate nearest neighbours with a hierarchical k-means tree searched best bin first.

The tree is grown on a bounded sample; every vector is then indexed: it goes down to the
leaf whose centres are nearest.  A query visits leaves in the order in which a priority
queue over the distances to the centres brings them up.  How many leaves it visits is
calibrated: for some vectors the exact neighbours are found by brute force over all rows,
and the number is raised until the leaves of ``recall`` of these neighbours are visited.

Rows meet queries in blocks of bounded size: a leaf's rows and its queries are dealt to
blocks, and every two of them meet in one task, so neither a large leaf nor many copies of one vector
end up in one task, and a block returns the best ``k`` of each query only.

Defined results: vectors that are null, empty or zero, have null or non-finite components
or another number of components than the sample's most common one take no part, neither as
queries nor as candidates; ties go to the smaller id; copies of a vector are neighbours at
distance 0; a repeated id is one candidate per row, and none of them is its own neighbour;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

#: The tree is grown on at most so many vectors, those with the least hash of their id.
FIT_ROWS = 20_000
BRANCHES = 8
#: Vectors of the sample in a leaf at most.
LEAF_ROWS = 100
CALIBRATION_QUERIES = 100
RECALL = 0.97
BLOCK_ROWS = 1024

FOUND = "query_id long, vec_id long, score double"


class Tree(NamedTuple):
    centres: np.ndarray  # of all nodes
    children: list[np.ndarray]  # of each node; none: a leaf
    leaf: np.ndarray  # number of each node's leaf or -1


def _split(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means from k-means++ seeds; the part of each row."""
    centres = x[rng.integers(len(x))][None]
    while len(centres) < BRANCHES:
        gap = ((x[:, None] - centres[None]) ** 2).sum(2).min(1) if len(x) * len(centres) < 1 << 16 else _squares(x, centres).min(1)
        if not gap.sum() > 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=gap / gap.sum())]])
    part = np.zeros(len(x), np.int64)
    for _ in range(10):
        part = _squares(x, centres).argmin(1)
        centres = np.array([x[part == c].mean(0) if (part == c).any() else centres[c] for c in range(len(centres))])
    return part


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def grow(sample: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 1) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, leaf, todo = [sample.mean(0)], [np.zeros(0, np.int64)], [-1], [(0, np.arange(len(sample)))]
    leaves = 0
    while todo:
        node, rows = todo.pop()
        part = _split(sample[rows], rng) if len(rows) > leaf_rows else np.zeros(len(rows), np.int64)
        parts = [rows[part == c] for c in np.unique(part)]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(parts))
        for p in parts:
            todo.append((len(centres), p))
            centres.append(sample[p].mean(0))
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
    return Tree(np.array(centres), children, np.array(leaf))


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    node = np.zeros(len(x), np.int64)
    while True:
        open_ = np.flatnonzero(tree.leaf[node] < 0)
        if not len(open_):
            return tree.leaf[node]
        for n in np.unique(node[open_]):
            rows = open_[node[open_] == n]
            below = tree.children[n]
            node[rows] = below[_squares(x[rows], tree.centres[below]).argmin(1)]


def visits(tree: Tree, q: np.ndarray, most: int) -> list[int]:
    """The first ``most`` leaves that a best-bin-first search reaches."""
    heap, out = [(0.0, 0)], []
    while heap and len(out) < most:
        _, node = heapq.heappop(heap)
        while tree.leaf[node] < 0:
            below = tree.children[node]
            gaps = ((tree.centres[below] - q) ** 2).sum(1)
            nearest = int(gaps.argmin())
            for i, gap in enumerate(gaps):
                if i != nearest:
                    heapq.heappush(heap, (float(gap), int(below[i])))
            node = below[nearest]
        out.append(int(tree.leaf[node]))
    return out


def valid(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _best(query: np.ndarray, ids: np.ndarray, own: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows of each query, exactly; rows of the query's own id left out."""
    out = []
    for at in range(0, len(query), 256):
        rough = _squares(query[at : at + 256], rows)
        rough[own[at : at + 256, None] == row_ids[None]] = np.inf
        for i, gaps in enumerate(rough):
            if len(gaps) > k:  # rounding of the rough squares is far below this margin
                limit = np.partition(gaps, k - 1)[k - 1]
                near = np.flatnonzero(gaps <= limit + 1e-9 * (1 + abs(limit)) * (1 + (query[at + i] ** 2).sum()))
            else:
                near = np.arange(len(gaps))
            near = near[np.isfinite(gaps[near])]
            exact = np.sqrt(((rows[near] - query[at + i]) ** 2).sum(1))
            order = np.lexsort((row_ids[near], exact))[:k]
            out += [(int(ids[at + i]), int(row_ids[near[o]]), float(exact[o])) for o in order]
    return out


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; Spark keeps only k of a query in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _calibrate(indexed: DataFrame, tree: Tree, k: int, recall: float, queries: int, seed: int) -> int:
    """The number of leaves to visit so that ``recall`` of the exact neighbours of some vectors are met."""
    chosen = indexed.orderBy(F.xxhash64(F.lit(seed + 1), "vec_id"), "vec_id").limit(queries).select("vec_id", "vector").toPandas()
    ids, points = chosen["vec_id"].to_numpy(np.int64), _matrix(chosen["vector"])
    sent = indexed.sparkSession.sparkContext.broadcast((ids, points))

    def search(parts):
        ids, points = sent.value
        for part in parts:
            leaf = dict(zip(part["vec_id"], part["leaf"]))
            best = _best(points, ids, ids, _matrix(part["vector"]), part["vec_id"].to_numpy(np.int64), k)
            yield pd.DataFrame([(*b, leaf[b[1]]) for b in best], columns=["query_id", "vec_id", "score", "leaf"])

    exact = indexed.select("vec_id", "vector", "leaf").mapInPandas(search, FOUND + ", leaf long")
    nearest = _first(exact, k).groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).toPandas()  # k leaves each
    place = []
    of = {int(i): p for i, p in zip(ids, points)}
    for query, found in zip(nearest["query_id"], nearest["leaves"]):
        order = {leaf: n for n, leaf in enumerate(visits(tree, of[query], len(tree.leaf)))}
        place += [order[leaf] + 1 for leaf in found]
    return int(np.quantile(place, recall, method="higher")) if place else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL, fit_rows: int = FIT_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the ``k`` nearest found among the other rows of
    ``vectors`` (vec_id, embedding), for the rows for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(valid(F.col("vector")) & F.col("vec_id").isNotNull())
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(fit_rows).select(F.size("vector").alias("n"), F.col("vector").cast("array<float>").alias("vector")).toPandas()
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    width = int(sample["n"].mode()[0])
    points = _matrix(sample.loc[sample["n"] == width, "vector"])
    tree = grow(points)
    tree_of = spark.sparkContext.broadcast(tree)

    def place(parts):
        for part in parts:
            yield part.assign(leaf=assign(tree_of.value, _matrix(part["vector"])) if len(part) else np.zeros(0, np.int64))

    indexed = saved(rows.where(F.size("vector") == width).mapInPandas(place, "vec_id long, vector array<double>, is_query boolean, leaf long"))
    most = _calibrate(indexed, tree, k, recall, CALIBRATION_QUERIES, seed)

    def route(parts):
        for part in parts:
            seen = [visits(tree_of.value, q, most) for q in _matrix(part["vector"])] if len(part) else []
            yield part.assign(leaves=seen)

    routed = indexed.where("is_query").select("vec_id", "vector").mapInPandas(route, "vec_id long, vector array<double>, leaves array<long>")
    routed = saved(routed.select("vec_id", "vector", F.explode("leaves").alias("leaf")))
    parts = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    blocks = parts(indexed, "blocks").join(parts(routed, "turns"), "leaf")
    dealt = lambda df, name: df.join(blocks, "leaf").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col(name)).cast("int"))
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    held = dealt(indexed, "blocks").select("leaf", F.col("own").alias("block"), upto("turns").alias("turn"), "vec_id", "vector")
    asked = dealt(routed, "turns").select("leaf", upto("blocks").alias("block"), F.col("own").alias("turn"), "vec_id", "vector")

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            ids = queries["vec_id"].to_numpy(np.int64)
            found = _best(_matrix(queries["vector"]), ids, ids, _matrix(rows["vector"]), rows["vec_id"].to_numpy(np.int64), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = asked.groupBy("leaf", "block", "turn").cogroup(held.groupBy("leaf", "block", "turn")).applyInPandas(search, FOUND)
    return _first(met, k).select("query_id", "rank", "vec_id", "score")
