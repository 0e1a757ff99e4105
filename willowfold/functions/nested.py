"""Values of nested rows that go by several names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A JSON text as a variant, read once for all its paths; null if it is no JSON."""
    return F.try_parse_json(text)


def first_path(value: Column, paths: list[str], fallback: Column | None = None) -> Column:
    """The text at the first of the paths ("a.b.c", steps of objects or places of arrays) that is there and neither null nor empty, else the fallback.

    What is missing on the way to a path's end, or is no object, counts as missing; an object at the end is its JSON text.
    """
    found = [F.nullif(F.try_variant_get(value, f"$.{p}", "string"), F.lit("")) for p in paths]
    return F.coalesce(*found, *([] if fallback is None else [fallback]))


def first_number(value: Column, paths: list[str], fallback: Column | None = None) -> Column:
    """``first_path`` as a finite number; a text that is none gives the fallback, and later paths are not asked."""
    number = F.trim(first_path(value, paths)).try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return finite if fallback is None else F.coalesce(finite, fallback)
