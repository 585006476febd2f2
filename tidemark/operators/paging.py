"""Pages of ordered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 .. offset + limit with their ``position``; ``truncated`` says whether more follow.

    One row more than the page is taken, so only offset + limit + 1 rows of each partition are kept.
    """
    taken = df.orderBy(*order).limit(offset + limit + 1)
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long")
    more = F.count("*").over(Window.partitionBy(F.lit(0))) > offset + limit
    rows = taken.select("*", position.alias("position"), more.alias("truncated"))
    return rows.where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def page_after(df: DataFrame, order: list[str], last: list, limit: int) -> DataFrame:
    """The next rows after one whose order columns are ``last``: no deep offset, whatever the page."""
    after = F.struct(*order) > F.struct(*(F.lit(v).alias(c) for c, v in zip(order, last)))
    return page(df.where(after), [F.col(c) for c in order], limit)


def snapshot(df: DataFrame) -> str:
    """A name for the files behind a frame; it changes when they do, and a page asked for under another name is refused."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(df.inputFiles())).encode()).hexdigest()
