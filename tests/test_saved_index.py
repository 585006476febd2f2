"""The saved index against scoring everything, and refreshed by course against a full build."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import index, search
from tidemark.streaming import jobs

FIELDS = {"title": 10.0, "body": 1.0}
SCHEMA = "course string, doc_id long, title string, body string"


def made_up(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    text = lambda k: " ".join(rng.choice(words, k, p=weights / weights.sum()))
    return {i: (f"c{rng.integers(5)}", text(2), text(int(rng.integers(0, 40)))) for i in range(n)}


def frame(spark, held):
    return spark.createDataFrame([(c, i, t, b) for i, (c, t, b) in held.items()], SCHEMA)


def courses(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "course string")


def told(spark, path):
    rows = spark.read.parquet(f"{path}/postings").where("term is not null").select("course", "term", "key", "tf", "length").collect()
    return sorted(map(tuple, rows)), sorted(map(tuple, index.documents(spark, path).select("course", "key", "length").collect()))


QUERIES = [(1, "w3 w17"), (2, "w0 w1 w2 w40"), (3, "w59"), (4, "w0"), (5, "nothing here"), (6, "w8 w9 w10 w11 w0")]


@pytest.mark.parametrize("whole", [0, 10**9])
def test_scores_and_best_equal_scoring_everything(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(index, "SCORED_WHOLE", whole)
    docs = frame(spark, made_up(1, 600))
    path = str(tmp_path / "index")
    index.write(docs, path, FIELDS, docs.select("course").distinct())
    asked = search.query_terms(spark.createDataFrame(QUERIES, "query_id long, query string"))
    every = search.bm25(search.postings(docs, FIELDS), search.corpus_stats(docs, list(FIELDS)), asked)
    key = lambda rows, c: sorted((r.query_id, r[c], round(r.rank_score, 6)) for r in rows)
    assert key(index.scores(spark, path, asked).collect(), "key") == key(every.collect(), "doc_id")
    for k in (1, 7, 1000):
        best = search.top(every.withColumn("rank_score", F.round("rank_score", 6)), [F.asc("rank_score"), F.asc("doc_id")], k)
        assert sorted((r.query_id, r["rank"], r.key) for r in index.best(spark, path, asked, k).collect()) == sorted((r.query_id, r["rank"], r.doc_id) for r in best.collect())


def test_a_query_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = frame(spark, made_up(2, 50))
    path = str(tmp_path / "index")
    index.write(docs, path, FIELDS, docs.select("course").distinct())
    found = index.postings(spark, path, spark.createDataFrame([("w3",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,w3)" in plan
    assert found.select("bucket").distinct().count() == 1


def test_refreshed_courses_equal_a_full_build(spark, tmp_path):
    held, path = made_up(3, 80), str(tmp_path / "index")
    sink = jobs.refresh_saved_index(path, lambda: frame(spark, held), FIELDS)
    batch = lambda *pairs: spark.createDataFrame(list(pairs), "old_course string, new_course string")
    sink(batch(*((None, f"c{i}") for i in range(5))), 0)
    untouched = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/postings/course=c4") for f in names}
    held[1] = ("c0", "moved", "w1 w2")
    gone = [i for i, (c, *_) in held.items() if c == "c2"]
    for i in gone:  # the course loses all its documents
        held[i] = ("c1", *held[i][1:])
    for _ in range(2):  # a batch that is run again
        sink(batch(("c0", "c0"), ("c1", "c1"), ("c2", "c1"), ("c3", "c3")), 1)
    docs = frame(spark, held)
    index.write(docs, str(tmp_path / "whole"), FIELDS, courses(spark, "c0", "c1", "c2", "c3", "c4"))
    assert told(spark, path) == told(spark, str(tmp_path / "whole"))
    if held[1][0] != "c4":
        now = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/postings/course=c4") for f in names}
        assert now == untouched


@pytest.mark.parametrize("rows", [[], [("c", 1, None, None), ("c", 2, "", " "), (None, 3, "w1", "w1")]])
def test_nothing_to_index(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    index.write(docs, path, FIELDS, courses(spark, "c"))
    asked = search.query_terms(spark.createDataFrame(QUERIES, "query_id long, query string"))
    assert index.best(spark, path, asked, 5).count() == 0 and index.documents(spark, path).count() == len(rows[:2])
