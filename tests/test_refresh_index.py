"""An index refreshed batch by batch against one full build."""

from pyspark.sql import functions as F

from tidemark.streaming import jobs

CHANGE = "old_course string, new_course string"


def build(docs):
    return docs.select("course", "doc_id", F.upper("body").alias("words"))


def test_batches_equal_a_full_build(spark, tmp_path):
    held = {}
    documents = lambda: spark.createDataFrame([(c, i, b) for i, (c, b) in held.items()], "course string, doc_id long, body string")
    path = str(tmp_path / "index")
    sink = jobs.refresh_index(path, documents, build)
    steps = [
        ({1: ("a", "one"), 2: ("a", "two"), 3: ("b", "three")}, [(None, "a"), (None, "b")]),
        ({4: ("a", "four")}, [(None, "a")]),  # one more document of a course
        ({3: ("a", "moved")}, [("b", "a")]),  # the last one of its course moves
    ]
    for n, (docs, changes) in enumerate(steps):
        held.update(docs)
        for _ in range(2):  # a batch that is run again
            sink(spark.createDataFrame(changes, CHANGE), n)
        assert sorted(spark.read.parquet(f"{path}/{n}").collect()) == sorted(build(documents()).collect())
