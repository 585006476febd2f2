"""Toxicity learned from labels of all languages, some of them on documents without any feature."""

from tidemark.llm import toxicity


def test_documents_without_features_do_not_spoil_the_keys(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    plain = spark.createDataFrame([(-1, "!!! 123", 0, 1), (-2, None, 1, 0)], "doc_id long, text string, quality int, toxic int")
    docs = docs.select("doc_id", "text").unionByName(plain.select("doc_id", "text"))
    labels = labels.select("doc_id", "quality", "toxic").unionByName(plain.drop("text").selectExpr("doc_id", "quality", "toxic"))
    held = labels.where("doc_id % 3 = 0 and doc_id >= 0")
    got = toxicity.score(docs, labels.join(held, "doc_id", "left_anti")).join(held, "doc_id").collect()
    toxic = [r for r in got if r.toxic]
    assert sum(r.rejected for r in toxic) >= 0.6 * len(toxic) and sum(r.rejected for r in got if not r.toxic) <= 0.05 * len(got)
