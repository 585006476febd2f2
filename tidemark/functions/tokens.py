"""Texts as arrays of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def words(c: Column) -> Column:
    """Runs of letters and of digits in lower case, and every other mark by itself."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]"), F.lit(0))
