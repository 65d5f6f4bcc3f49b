"""Running values along an array, in the row, with work in proportion to its length.

An aggregate that appends to its result copies it at every step. Here an array is cut into blocks:
inside a block the result is short, and between blocks there is one value each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

BLOCK = 256


def _before(values: Column, first: Column, join: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        values,
        start,
        lambda a, v: F.struct(join(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )


def running(values: Column, first: int, join: Callable[[Column, Column], Column]) -> Column:
    """Per element of an array of ints what ``join`` makes of ``first`` and all elements before it.

    ``join`` must be associative, with ``first`` as its neutral element. An empty array gives one.
    """
    zero = F.lit(first).cast("int")

    def body(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))

        def chained(b: Column) -> Column:
            totals = F.transform(b, lambda x: F.aggregate(x, zero, join))
            return F.flatten(F.zip_with(b, _before(totals, zero, join), lambda x, at: _before(x, at, join)))

        return let(blocks, chained)

    return let(values, body)


def running_sum(values: Column) -> Column:
    """Per element the sum of all elements before it."""
    return running(values, 0, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    """Per element of non-negative ints the largest before it, 0 before the first."""
    return running(values, 0, lambda a, b: F.greatest(a, b))


def running_min(values: Column) -> Column:
    """Per element the least before it, the largest int before the first."""
    return running(values, 2**31 - 1, lambda a, b: F.least(a, b))
