"""Array helpers for DataFrame expressions whose cost stays near linear in the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once, however often ``use`` and the lambdas in it name it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative ``combine``, by doubling: n log n steps and no array that grows by copies."""

    def doubled(held: Column) -> Column:
        steps = F.filter(F.lit([1 << b for b in range(30)]), lambda d: d < F.size(held))
        return F.aggregate(steps, held, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, combine(F.get(acc, i - d), x)).otherwise(x)))

    return bound(values, doubled)
