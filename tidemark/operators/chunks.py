"""Documents to ordered chunks, within budgets, and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_lines(docs: DataFrame) -> DataFrame:
    """One chunk per line that isn't blank: doc_id, ordinal (dense, from 0), line (its number), text."""
    lines = docs.select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("line"), t.alias("text"))), lambda x: F.trim(x.text) != "").alias("lines"))
    return lines.select("doc_id", F.posexplode("lines").alias("ordinal", "x")).select("doc_id", "ordinal", "x.line", "x.text")


def apply_text_budget(chunks: DataFrame, per_chunk: int, per_doc: int, max_chunks: int) -> DataFrame:
    """Chunks cut to ``per_chunk`` characters while their document's budget lasts; ``partial`` marks what was cut or dropped before."""
    cut = chunks.withColumn("n", F.least(F.length("text"), F.lit(per_chunk)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = cut.withColumn("left", F.lit(per_doc) - before).where((F.col("ordinal") < max_chunks) & (F.col("left") > 0))
    take = F.least("n", "left").cast("int")
    return kept.select("doc_id", "ordinal", F.substring("text", F.lit(1), take).alias("text"), (take < F.length("text")).alias("partial"))


def neighbors(hits: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Chunks up to ``n`` places before and after each hit (doc_id, ordinal), as an equi join on the exploded places."""
    wanted = hits.select("doc_id", F.col("ordinal").alias("hit"), F.explode(F.sequence(F.col("ordinal") - n, F.col("ordinal") + n)).alias("ordinal"))
    return chunks.join(wanted, ["doc_id", "ordinal"])


def pages_to_review(chunks: DataFrame, flags: str = "flags") -> DataFrame:
    """Chunks that some flag speaks against."""
    return chunks.where(F.size(flags) > 0)
