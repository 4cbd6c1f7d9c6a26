"""Scenario-code and name expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_first(c: Column, text: str) -> Column:
    """Remove the first occurrence of ``text`` only."""
    return F.regexp_replace(c, f"^(.*?){re.escape(text)}", "$1")


def name_piece(c: Column, i: int, sep: str = "_") -> Column:
    """The i-th piece of a delimited name; NULL where the name has fewer pieces."""
    return F.get(F.split(c, re.escape(sep)), F.lit(i))


def code_pieces(c: Column, cuts: tuple[int, ...]) -> list[Column]:
    """Split a fixed-width code after each of the ``cuts`` positions."""
    starts = (0, *cuts)
    widths = [b - a for a, b in zip(starts, cuts)]
    head = [F.substring(c, a + 1, w) for a, w in zip(starts, widths)]
    tail = F.substr(c, F.lit(starts[-1] + 1))
    return [*head, tail]


def last_chars(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def lookup(c: Column, table: dict[str, str | None]) -> Column:
    """Value of a small fixed dictionary; NULL for an unknown key."""
    if not table:
        return F.lit(None).cast("string")
    entries = [F.lit(x).cast("string") for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), c)
