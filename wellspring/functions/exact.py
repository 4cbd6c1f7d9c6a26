"""Sums of doubles that do not depend on the order or the partitioning of rows.

A double is cut, without error, into whole numbers of fixed units 2**31 apart. Whole numbers
are added exactly, in any order; the parts of the total are carried and joined at the end. So
a sum is the same bits on 1 partition and on 211, after a retry, and under any join plan.

    with exact_sums():
        ghg = LcaPlan(facts).ghg      # every strict sum of the analysis is exact

Numbers from 2**-71 to 2**62 keep all their digits; smaller ones are cut at 2**-124, NaN, the
infinities and larger ones are added as doubles. Up to 2**32 rows fit a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS, _PARTS = 31, 6
#: Units of the parts, greatest first: 2**31, 1, 2**-31, …, 2**-124.
_UNITS = tuple(2.0 ** (_BITS * (1 - k)) for k in range(_PARTS))
_LIMIT = 2.0**62

_exact: ContextVar[bool] = ContextVar("exact_sums", default=False)


@contextmanager
def exact_sums() -> Iterator[None]:
    """Sums declared inside are exact."""
    token = _exact.set(True)
    try:
        yield
    finally:
        _exact.reset(token)


def wanted() -> bool:
    return _exact.get()


def exact_sum(c: Column) -> Column:
    """The sum over non-null terms, as the same double whatever the order; NULL without any."""
    inside = F.abs(c) < _LIMIT
    x = F.when(inside, c)
    rests = [x, *[x % F.lit(u) for u in _UNITS]]  # what lies below each unit; exact
    sums = [
        F.coalesce(F.sum(((above - below) / F.lit(u)).cast("bigint")), F.lit(0).cast("bigint"))
        for above, below, u in zip(rests, rests[1:], _UNITS)
    ]
    # carry, so that all parts but the first are at most half the unit above, of either sign:
    # adding them, least first, then loses no more than the last bit
    half = F.lit(1 << (_BITS - 1))
    total = None
    carry = F.lit(0).cast("bigint")
    for part, unit in reversed(list(zip(sums[1:], _UNITS[1:]))):
        whole = part + carry
        carry = F.shiftright(whole + half, _BITS)
        term = (whole - F.shiftleft(carry, _BITS)).cast("double") * F.lit(unit)
        total = term if total is None else total + term
    total = total + (sums[0] + carry).cast("double") * F.lit(_UNITS[0])
    others = F.sum(F.when(~inside | F.isnan(c), c))
    return F.when(F.count(c) > 0, F.when(others.isNull(), total).otherwise(others + total))
