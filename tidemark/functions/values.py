"""Values of fields and of source records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import times, wording

TIME_FIELDS = ("start_time", "end_time", "due_time")


def semantic_value(field: Column, value: Column) -> Column:
    """What has to be equal for two values of a field to say the same: a title's identity, a time's signature, else the trimmed text in lower case."""
    signature = times.temporal_signature(times.temporal_value(value))
    return F.when(field == "title", wording.title_identity(value)).when(field.isin(*TIME_FIELDS), signature).otherwise(F.lower(F.trim(value)))


def availability(flag: Column) -> Column:
    """ACTIVE or UNAVAILABLE from a boolean; UNKNOWN from none."""
    return F.when(flag, "ACTIVE").when(~flag, "UNAVAILABLE").otherwise("UNKNOWN")


#: Visibilities that sources name.
VISIBLE, HIDDEN = ("VISIBLE", "AVAILABLE"), ("HIDDEN", "UNAVAILABLE")


def visibility(name: Column) -> Column:
    upper = F.upper(name)
    return F.when(upper.isin(*VISIBLE), "ACTIVE").when(upper.isin(*HIDDEN), "UNAVAILABLE").otherwise("UNKNOWN")


def json_typed(body: Column, path: str, kind: str) -> Column:
    """The value at ``path`` of a JSON text if it has this type (string, bigint, double, boolean), else null; no casts between types."""
    at = F.try_variant_get(F.try_parse_json(body), path, "variant")
    found = F.schema_of_variant(at)
    return F.when(F.lower(found) == kind, F.try_variant_get(at, "$", kind))


def term(body: Column) -> Column:
    """A term given as a text or as an object with a name or display name; blank texts don't count."""
    filled = lambda path: F.when(F.trim(json_typed(body, path, "string")) != "", json_typed(body, path, "string"))
    return F.coalesce(filled("$.term"), filled("$.term.name"), filled("$.term.displayName"))
