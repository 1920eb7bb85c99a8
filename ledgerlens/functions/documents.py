"""JSON text columns: read, merge, append."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(document: Column, *path: str) -> Column:
    """Text of a nested field, null when absent."""
    return F.get_json_object(document, "$" + "".join(f".{name}" for name in path))


def merged(document: Column, extra: Column) -> Column:
    """JSON object with the fields of ``extra`` (a map of JSON values) set; nested values are kept.

    Null for text that is no JSON object: the caller decides what becomes of it.
    """
    known = F.from_json(F.coalesce(document, F.lit("{}")), "map<string,variant>")
    added = F.from_json(extra, "map<string,variant>")
    kept = F.map_filter(known, lambda name, _: ~F.array_contains(F.map_keys(added), name))
    return F.to_json(F.map_concat(kept, added))


def appended(entries: Column, entry: Column) -> Column:
    """Array with one more entry; a null array counts as empty."""
    return F.when(entries.isNull(), F.array(entry)).otherwise(F.concat(entries, F.array(entry)))
