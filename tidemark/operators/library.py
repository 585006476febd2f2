"""Library views, trees, rejects and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.latest import newest


def list_materials(resources: DataFrame, versions: DataFrame, historical: bool = False) -> DataFrame:
    """Resources with their current version, or with every version that they have."""
    if historical:
        return resources.join(versions, "resource_key")
    current = versions.groupBy("resource_key").agg(F.max_by(F.struct(*(c for c in versions.columns if c != "resource_key")), "version_number").alias("row"))
    return resources.join(current, "resource_key", "left").select(*resources.columns, "row.*")


def get_resource(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The version that is asked for, else the newest. ``wanted``: resource_key, version (or null)."""
    last = versions.groupBy("resource_key").agg(F.max("version_number").alias("newest"))
    asked = wanted.join(last, "resource_key").select("resource_key", F.coalesce("version", "newest").alias("version_number"))
    return versions.join(asked, ["resource_key", "version_number"])


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with the names of the rules that they break."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    judged = df.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def redact_private(df: DataFrame, private: tuple[str, ...]) -> DataFrame:
    """Without private columns, also inside of structs."""
    kept = df.drop(*private)
    for field in kept.schema:
        if field.dataType.typeName() == "struct":
            inner = [f.name for f in field.dataType if f.name in private]
            kept = kept.withColumn(field.name, F.col(field.name).dropFields(*inner)) if inner else kept
    return kept


def resolve_sources(refs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """References (kind, key) to what they name; each table has key and title. Unknown ones keep a null title."""
    named = reduce(DataFrame.unionByName, (t.select(F.lit(kind).alias("kind"), "key", "title") for kind, t in tables.items()))
    return refs.join(named, ["kind", "key"], "left")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """node, root, depth, path of every node of a parent tree (node, parent); what hangs on a cycle or a missing parent has none.

    One equi join a level, down to the last one; the lineage is cut by the checkpoint of each level. A node that is on its
    own path ends it.
    """
    from_root = nodes.where("parent is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path"))
    level, found = from_root, [from_root]
    while True:
        level = nodes.where("parent is not null").join(level.select(F.col("node").alias("parent"), "root", "depth", "path"), "parent").where(~F.array_contains("path", F.col("node"))).select("node", "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("node")).alias("path"))
        level = level.checkpoint() if level.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else level.persist()
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def find_cycles(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Nodes of a parent table (node, parent) that lie on a cycle: those that reach themselves, by doubling the step each round."""
    step = edges.where("parent is not null").select("node", F.col("parent").alias("to"))
    on_cycle = step.where("node = to").select("node")
    for _ in range(rounds):
        further = step.join(step.toDF("to", "beyond"), "to").select("node", F.col("beyond").alias("to"))
        step = further.checkpoint() if further.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else further.persist()
        if step.isEmpty():
            return on_cycle.distinct()
        on_cycle = on_cycle.union(step.where("node = to").select("node"))
    # After 2^rounds steps only cycles and what leads into them is left; targets of far steps lie on cycles.
    return on_cycle.union(step.select(F.col("to").alias("node"))).distinct()


def audit(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: each frame has the rows that break its rule."""
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, counts)


def page_coverage(pages: DataFrame) -> DataFrame:
    """scope, pages, coverage: COMPLETE if the offsets follow each other and the last page reaches the total.

    ``pages``: scope, offset, n, total.
    """
    following = F.lead("offset").over(Window.partitionBy("scope").orderBy("offset"))
    joined = pages.withColumn("next", following).withColumn("fits", F.when(F.col("next").isNull(), F.col("offset") + F.col("n") >= F.col("total")).otherwise(F.col("next") == F.col("offset") + F.col("n")))
    whole = F.bool_and("fits") & (F.min("offset") == 0) & (F.countDistinct("total") == 1)
    return joined.groupBy("scope").agg(F.count("*").alias("pages"), F.when(whole, "COMPLETE").otherwise("PARTIAL").alias("coverage"))


def merge_pages(items: DataFrame, max_pages: int, max_items: int) -> tuple[DataFrame, DataFrame]:
    """The first occurrence of each item within the limits, and per scope what was left out.

    ``items``: scope, page, position, remote_id. Limits are those of the source's contract; what they cut makes the scope PARTIAL.
    """
    by = Window.partitionBy("scope", "remote_id").orderBy("page", "position")
    ranked = items.withColumn("nth", F.row_number().over(by)).withColumn("page_no", F.dense_rank().over(Window.partitionBy("scope").orderBy("page")))
    inside = ranked.where((F.col("nth") == 1) & (F.col("page_no") <= max_pages))
    inside = inside.withColumn("item_no", F.row_number().over(Window.partitionBy("scope").orderBy("page", "position")))
    kept = inside.where(F.col("item_no") <= max_items).drop("nth", "page_no", "item_no")
    seen = ranked.groupBy("scope").agg(F.count("*").alias("seen"), F.count_if(F.col("nth") > 1).alias("duplicates"), F.max("page_no").alias("pages"))
    held = kept.groupBy("scope").agg(F.count("*").alias("kept"))
    joined = seen.join(held, "scope", "left").na.fill(0, ["kept"])
    partial = (F.col("duplicates") > 0) | (F.col("pages") > max_pages) | (F.col("seen") - F.col("duplicates") > F.col("kept"))
    return kept, joined.select("scope", "seen", "kept", "duplicates", F.when(partial, "PARTIAL").otherwise("COMPLETE").alias("coverage"))


def derivation_coverage(inputs: DataFrame, extractions: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Per course: COMPLETE if every current input has a complete extraction, of itself or of equal content, and nothing is unresolved.

    ``inputs``: course_key, input_key, content_hash; ``extractions``: extraction_key, content_hash, coverage; ``unresolved``: course_key.
    """
    last = extractions.groupBy("content_hash").agg(newest(F.col("coverage"), ("extraction_key",)).alias("coverage"))
    open_ = unresolved.groupBy("course_key").agg(F.count("*").alias("unresolved"))
    per = inputs.join(last, "content_hash", "left").groupBy("course_key").agg(F.count("*").alias("inputs"), F.count_if(F.col("coverage") == "COMPLETE").alias("complete"))
    joined = per.join(open_, "course_key", "left").na.fill(0, ["unresolved"])
    state = F.when((F.col("inputs") == F.col("complete")) & (F.col("unresolved") == 0), "COMPLETE").otherwise("PARTIAL")
    return joined.withColumn("coverage", state)
