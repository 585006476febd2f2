"""A saved inverted index: written once, refreshed by course, read only where a query's terms are.

``postings`` lie by course and by bucket of their term, sorted by term in each file; ``documents`` hold the
length of each document, by course.  A query reads the buckets of its terms alone, and of
these files only the parts whose range of terms it may need.

A refresh overwrites the partitions of the courses that changed and no others.  Every
partition of a course holds one row of nulls at least, so one that has lost its last posting is
overwritten too.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators import search
from tidemark.operators.lineage import cut, shared_folder

BUCKETS = 8
#: Up to so many terms are named in the filter that reaches the files; beyond that they are joined.
NAMED_TERMS = 500
#: Queries that meet no more postings than this in all are scored whole.
SCORED_WHOLE = 50_000_000
#: Scores are compared in so many digits; bounds leave as much room.
DIGITS, ROOM = 6, 2e-6


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, by: list[str]) -> None:
    # Rebalancing splits what very many rows share, such as a term that all documents have.
    order = [c for c in (*by, "term") if c in rows.columns]
    rows.hint("rebalance", *by).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write(docs: DataFrame, path: str, fields: dict[str, float], courses: DataFrame, key: str = "doc_id", course: str = "course") -> None:
    """Writes the index of ``docs`` (key, course, fields), which are all documents of ``courses`` (course); others stay as they are."""
    rows = docs.select(F.col(course).cast("string").alias("course"), F.col(key).alias("key"), *fields).where("course is not null").join(search.small(courses.select(F.col("course").cast("string"))), "course", "left_semi")
    words = sum((F.size(tokens(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0))
    every = courses.select(F.col("course").cast("string").alias("course")).distinct()
    found = search.postings(rows.select(F.struct("course", "key").alias("place"), *fields), fields, "place")
    found = found.select("place.course", bucket_of(F.col("term")).alias("bucket"), "term", "place.key", "tf", "length")
    marks = every.select("course", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    _write(found.unionByName(marks, allowMissingColumns=True), f"{path}/postings", ["course", "bucket"])
    held = rows.select("course", "key", words.cast("long").alias("length"))
    _write(held.unionByName(every, allowMissingColumns=True), f"{path}/documents", ["course"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents").where("key is not null")


def stats(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path).agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))


def postings(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The postings of the ``wanted`` terms (term), read from their buckets only."""
    few = [r.term for r in wanted.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    buckets = [r[0] for r in wanted.select(bucket_of(F.col("term"))).distinct().collect()]  # at most BUCKETS
    rows = spark.read.schema("term string, key long, tf double, length int, course string, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(*buckets) & F.col("term").isNotNull())
    return rows.where(F.col("term").isin(*few)) if len(few) <= NAMED_TERMS else rows.join(search.small(wanted.select("term").distinct()), "term", "left_semi")


def scores(spark: SparkSession, path: str, queries: DataFrame, mode: str = "any") -> DataFrame:
    """query_id, key, rank_score of all documents that have any, or all, of a query's terms (query_id, terms)."""
    found = postings(spark, path, search.asked_terms(queries))
    return search.bm25(found, stats(spark, path), queries, mode, "key")


def _parts(found: DataFrame) -> DataFrame:
    """Postings with ``part``: what each adds to a score, and ``bound``, the most that its term adds to any."""
    counted = found.groupBy("term").agg(F.count("*").alias("n"), F.max(_saturated(F.col("mean_length"))).alias("most"))
    full = found.join(search.small(counted), "term")
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    return full.select("term", "key", (idf * _saturated(F.col("mean_length"))).alias("part"), (idf * F.col("most")).alias("bound"))


def _saturated(mean: Column) -> Column:
    return F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("length") / mean))


def best(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """query_id, key, rank_score, rank of the ``k`` best documents of each query, ties to smaller keys; scores to six digits.

    The documents of a query's weightiest term are scored whole, and the k-th of them is a threshold.  Terms whose bounds
    together stay below it bring no document in, so their postings are joined to the documents of the other terms
    only, and not scored for all that hold them.  Either way the result is the same.
    """
    found = postings(spark, path, search.asked_terms(queries)).crossJoin(F.broadcast(stats(spark, path)))  # one row
    parts = cut(_parts(found))
    bounds = parts.groupBy("term").agg(F.max("bound").alias("bound"), F.count("*").alias("n"))
    asked = cut(queries.select("query_id", F.explode("terms").alias("term")).join(search.small(bounds), "term"))
    by_bound = Window.partitionBy("query_id").orderBy("bound", "term")  # at most MAX_TERMS rows each
    asked = asked.select("*", F.sum("bound").over(by_bound.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")).alias("nth"))
    score = (-F.round(F.sum("part"), DIGITS) + 0.0).alias("rank_score")

    def whole(terms: DataFrame) -> DataFrame:
        """The scores of all documents that hold one of these terms of a query."""
        held = parts.join(search.small(terms.select("query_id", "term")), "term").select("query_id", "key").distinct()
        every = parts.join(search.small(asked.select("query_id", "term")), "term")
        return every.join(held, ["query_id", "key"], "left_semi").groupBy("query_id", "key").agg(score)

    if (asked.agg(F.sum("n")).first()[0] or 0) <= SCORED_WHOLE:  # then looking for a threshold costs more than it saves
        every = parts.join(search.small(asked.select("query_id", "term")), "term").groupBy("query_id", "key").agg(score)
        return search.top(every, [F.asc("rank_score"), F.asc("key")], k)
    first = search.top(whole(asked.where("nth = 1")), [F.asc("rank_score"), F.asc("key")], k)
    least = first.where(F.col("rank") == k).select("query_id", (-F.col("rank_score")).alias("least"))
    needed = asked.join(search.small(least), "query_id", "left").where(F.col("least").isNull() | (F.col("upto") + ROOM >= F.col("least")))
    return search.top(whole(needed), [F.asc("rank_score"), F.asc("key")], k)


def saved_index(spark: SparkSession, source: str, fields: dict[str, float], course: str) -> str:
    """The path of the index of the table at ``source``, written now if there is none of the files as they are; courses without a name share one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    snapshot = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)
    name = hashlib.sha256(repr((source, snapshot, sorted(fields.items()), course, BUCKETS)).encode()).hexdigest()[:20]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/index-{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        draft = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        docs = spark.read.parquet(source).withColumn("course", F.coalesce(F.col(course).cast("string"), F.lit("")))
        write(docs, draft, fields, docs.select("course").distinct())
        files.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), path)
    return str(path)
