from pyspark.sql import functions as F

from tidemark.operators import answers, sources


def test_scopes_of_other_kinds(spark):
    courses = spark.createDataFrame([("p", 1)], "provider string, course_key long")
    assert answers.search_scopes(courses, ("note",)).collect() == []
    since, until = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-01", "2024-02-01"))
    rows = {r.scope: r for r in answers.event_scopes(courses, since, until).collect()}
    assert rows["schedule"].since is not None and rows["content"].since is None and rows["schedule"].coverage is None


def test_provenance_warnings_and_context(spark):
    row = answers.provenance(spark.createDataFrame([(1, 2, "t", "x")], "source_key long, observation_key long, observed_at string, title string")).first()
    assert row.title == "x" and row.provenance.asDict() == {"source_key": 1, "observation_key": 2, "observed_at": "t"}
    texts = lambda *t: F.array(*(F.lit(x) for x in t))
    found = spark.range(1).select(
        answers.merged_warnings(texts("b", "a"), F.lit(None).cast("array<string>"), texts("a", "c")).alias("merged"),
        sources.shares_context(texts("source:1", "content:2"), texts("content:2")).alias("shared"),
        sources.shares_context(texts("source:1"), texts("content:2")).alias("other"),
    ).first()
    assert found.merged == ["b", "a", "c"] and found.shared and not found.other


def test_filters_without_versions(spark):
    rows = spark.createDataFrame([(1, None, 0.5, "derived:ocr"), (1, 1, None, "native"), (1, 2, 0.9, "derived:x")], "resource_key long, version_key int, confidence double, text_origin string")
    rows = rows.selectExpr("*", "'chunk' as entity_kind", "'en' as semantic_type", "'pdf' as file_format", "'ACTIVE' as availability")
    current = spark.createDataFrame([(1, 2)], "resource_key long, current_version int")
    keep = lambda **f: sorted(str(r.version_key) for r in answers.apply_filters(rows, answers.Filters(**f), current).collect())
    assert keep() == ["2", "None"] and keep(historical=True) == ["1", "2", "None"] and keep(min_confidence=0.6) == ["2"]
    assert keep(origins=("native",), historical=True) == ["1"] and keep(origins=("derived",)) == ["2", "None"] and keep(version_key=1, historical=True) == ["1"]
