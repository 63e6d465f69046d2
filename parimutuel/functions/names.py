"""Team names and how they are matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def alike(a: Column, b: Column, require_nonempty: bool = True) -> Column:
    """Whether one normalized name holds the other.

    A name without Latin letters or digits normalizes to nothing, and nothing is held
    by every name. Such names match none here unless ``require_nonempty`` is off.
    """
    return alike_normal(normalized(a), normalized(b), require_nonempty)


def alike_normal(x: Column, y: Column, require_nonempty: bool = True) -> Column:
    """``alike`` of names that are normalized already."""
    held = F.contains(x, y) | F.contains(y, x)
    return held & (x != "") & (y != "") if require_nonempty else held
