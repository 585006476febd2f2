"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import codes, html, language, license, linededup, media, mixing, neardup, neighbours, packing, quality, resample, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.sniff_column(media.store_texts(_table(spark, sf_dir, "documents"))))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("spans"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lines", "exact", "near", "links", F.md5("text").alias("kept_md5"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("domain", mixing.domain_of(F.col("source")))
    taken, _ = mixing.mix_sources(docs, mixing.WEIGHTS, mixing.BUDGET_SHARE)
    return taken.drop("text_key")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_low_quality", "p_toxic", "p_toxic_low_quality", "rejected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer())


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("judged")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neighbours, op2_bagminhash, op3_html, op4_license, op5_media, op6_language, op7_linededup, op8_mixing, op9_toxicity, op10_packing, op11_resample, op12_codes, op13_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op7_linededup": linededup.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op11_resample": resample.ORACLE_SQL, "op12_codes": codes.ORACLE_SQL, "op13_quality": quality.ORACLE_SQL}
