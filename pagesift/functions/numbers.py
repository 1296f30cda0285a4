"""Rounding as the reports show it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_tenth(x: Column) -> Column:
    """A value from 0 to 100 to one decimal, ties to even, going by its exact binary value.

    ``bround`` goes by the shortest decimal that names the double: it takes 0.35 for
    a tie, though the double lies below. Where that decimal ends in a five, the side
    is found by splitting the double into two parts whose hundredfolds are exact.
    """
    n = F.round(x * 100)
    looks_tied = (n % 10 == 5) & (n / 100 == x)
    high = F.floor(x * 1048576) / 1048576
    side = (high * 100 - n) + (x - high) * 100
    tenths = F.floor(n / 10)
    return (
        F.when(looks_tied & (side < 0), tenths / 10)
        .when(looks_tied & (side > 0), (tenths + 1) / 10)
        .otherwise(F.bround(x, 1))
    )
