"""Map helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.schema import empty_map


def upsert(old: Column, new: Column) -> Column:
    """``old`` with the entries of ``new`` put over it (``map_concat`` alone rejects duplicate keys)."""
    kept = F.map_filter(old, lambda key, _: ~F.map_contains_key(new, key))
    return F.map_concat(kept, new)


def from_pairs(pairs: dict[str, Column]) -> Column:
    """A string map that leaves out the keys whose value is null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    present = F.filter(entries, lambda entry: entry["value"].isNotNull())
    return F.coalesce(F.map_from_entries(present), empty_map())


def sorted_map(column: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(column)))
