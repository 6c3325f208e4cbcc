"""Small builders that the Column functions share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: dict, other=None) -> Column:
    """The value of a small table for a key; ``other`` for any other key (and null)."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(pairs, key)
    return found if other is None else F.coalesce(found, F.lit(other))


def sum_of(columns) -> Column:
    """Adds columns from left to right, so that doubles round alike everywhere."""
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out


def let(value: Column, fn) -> Column:
    """fn(value), with the value computed once however often fn uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: fn(v)), 1)


def any_of(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")
