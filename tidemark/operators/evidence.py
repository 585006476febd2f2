"""Evidence that comes in pieces: chains of pages, and descriptions of what was rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


def page_chains(pages: DataFrame, max_pages: int) -> DataFrame:
    """scope, pages, reached, warnings: what became of following the cursors of each scope from its first page.

    ``pages``: scope, page, next_page (null at the end), first (boolean); a scope's pages are distinct, one of them is first.
    Warnings: PAGE_CURSOR_CYCLE, PAGE_MISSING, PAGE_CAP (more than ``max_pages``), PAGES_NOT_REACHED, NO_FIRST_PAGE.
    ``reached`` is null for a cycle.  Each round doubles how far every page sees, so rounds grow with the logarithm of
    the longest chain; who still sees a page after that runs in a circle.
    """
    own = pages.select("scope", F.col("page").alias("target"), F.lit(True).alias("there"))
    jumps = pages.select("scope", "page", F.col("next_page").alias("target")).join(own, ["scope", "target"], "left")
    # target: the page that is seen, null if the chain has ended before; end: how it ended.
    ended = F.when(F.col("target").isNull(), "END").when(F.col("there").isNull(), "PAGE_MISSING")
    jumps = cut(jumps.select("scope", "page", F.when(ended.isNull(), F.col("target")).alias("target"), F.lit(1).cast("long").alias("steps"), ended.alias("ended")))
    longest = pages.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):
        further = jumps.select("scope", F.col("page").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("later"))
        joined = jumps.join(further, ["scope", "target"], "left")
        jumps = cut(joined.select("scope", "page", F.col("next").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("ended", "later").alias("ended")))
    starts = pages.where("first").select("scope", "page").join(jumps, ["scope", "page"])
    totals = pages.groupBy("scope").agg(F.count("*").alias("pages"))
    joined = totals.join(starts, "scope", "left")
    circle = F.col("page").isNotNull() & F.col("ended").isNull()
    reached = F.when(~circle, F.coalesce("steps", F.lit(0)))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("page").isNull(), "NO_FIRST_PAGE"),
            F.when(circle, "PAGE_CURSOR_CYCLE"),
            F.when(F.col("ended") == "PAGE_MISSING", "PAGE_MISSING"),
            F.when(reached > max_pages, "PAGE_CAP"),
            F.when(reached < F.col("pages"), "PAGES_NOT_REACHED"),
        )
    )
    return joined.select("scope", "pages", reached.cast("long").alias("reached"), warnings.alias("warnings"))


def visual_history(descriptions: DataFrame, renders: DataFrame) -> DataFrame:
    """Every description with the newest render of the same content at its time, and whether it still holds.

    ``descriptions``: description_key, artifact, content_hash, described_at; ``renders``: render_key, artifact, content_hash,
    rendered_at.  Adds render_key and rendered_at (null if none was there yet) and ``is_current``: it is the last description of its
    artifact and content, and the artifact was last rendered with that content.  Equal times are told apart by key.
    """
    by = ["artifact", "content_hash"]
    render = F.struct("rendered_at", "render_key")
    there = renders.where("content_hash is not null").select(*by, F.col("rendered_at").alias("at"), F.lit(0).alias("kind"), F.col("render_key").alias("key"), render.alias("render"))
    said = descriptions.select(*by, F.col("described_at").alias("at"), F.lit(1).alias("kind"), F.col("description_key").alias("key"))
    order = Window.partitionBy(*by).orderBy("at", "kind", "key")
    rows = there.unionByName(said, allowMissingColumns=True)
    rows = rows.select(*by, "at", "kind", "key", F.last("render", True).over(order).alias("render"), F.max(F.when(F.col("kind") == 1, F.struct("at", "key"))).over(Window.partitionBy(*by)).alias("last")).where("kind = 1")
    newest = renders.groupBy("artifact").agg(F.max_by("content_hash", render).alias("shown"))
    joined = rows.join(newest, "artifact", "left")
    current = F.coalesce((F.struct("at", "key") == F.col("last")) & (F.col("content_hash") == F.col("shown")), F.lit(False))
    return joined.select(F.col("key").alias("description_key"), *by, F.col("at").alias("described_at"), "render.render_key", "render.rendered_at", current.alias("is_current"))
