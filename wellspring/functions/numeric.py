"""Arithmetic with IEEE division and explicit missing-value rules.

Spark in ANSI mode raises on x/0 and its sum skips NULL. The analysis instead needs
x/0 to give NaN or an infinity, and a sum over any missing term to be missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.functions import exact

NAN = float("nan")
INFINITY = float("inf")


def missing(c: Column) -> Column:
    """NULL or NaN."""
    return c.isNull() | F.isnan(c)


def fill_missing(c: Column, value: float) -> Column:
    return F.when(missing(c), F.lit(value)).otherwise(c)


def ieee_div(n: Column, d: Column) -> Column:
    """Double division: x/0 is NaN or an infinity, NULL operands give NULL."""
    by_zero = (
        F.when(n.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(n) | (n == 0), F.lit(NAN))
        .when(n > 0, F.lit(INFINITY))
        .otherwise(F.lit(-INFINITY))
    )
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def strict_sum(c: Column) -> Column:
    """Sum that is NULL as soon as one term is NULL."""
    total = exact.exact_sum(c) if exact.wanted() else F.sum(c)
    return F.when(F.count(c) == F.count(F.lit(1)), total)


def sum_present(c: Column) -> Column:
    """Sum over the terms that are neither NULL nor NaN; 0 when there are none."""
    present = F.when(~missing(c), c)
    return F.coalesce(exact.exact_sum(present) if exact.wanted() else F.sum(present), F.lit(0.0))


#: Doubles from here on have no digits left behind a unit of 1e-15 of their size.
_DIGITS_OF_A_DOUBLE = 15


def round_nearest(c: Column, digits: int) -> Column:
    """Round to the nearer of the two neighbouring decimals, as doubles; a tie to the even one.

    The candidates are the numbers of ``digits`` decimals below and above. Which is nearer is
    decided on the doubles themselves, so 0.15 (a little less than its name) becomes 0.1 and
    2.5 becomes 2. Numbers with no digits left to round stay as they are.
    """
    scale, size = F.lit(10.0**digits), F.abs(c)
    low = F.floor(size * scale)
    below, above = low / scale, F.ceil(size * scale) / scale
    to_below, to_above = size - below, above - size
    nearer = F.when(
        (to_below < to_above) | ((to_below == to_above) & (F.pmod(low, F.lit(2)) == 0)), below
    ).otherwise(above)
    signed = F.when((c < 0) & (nearer != 0), -nearer).otherwise(nearer)
    return F.when(F.isnan(c) | (size >= 10.0 ** (_DIGITS_OF_A_DOUBLE - digits)), c).otherwise(signed)
