"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is evaluated again for every element, so whole-array results
    such as a sum or a maximum are bound to a lambda variable first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(c: Column) -> Column:
    """Unit-length vector from an array column; a zero vector stays zero."""
    squares = let(c.cast("array<double>"), lambda v: F.struct(
        v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("length")))
    return let(squares, lambda s: F.when(s["length"] > 0, F.transform(s["v"], lambda x: x / s["length"])).otherwise(s["v"]))
