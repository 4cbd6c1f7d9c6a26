"""Fingerprints of fact tables by scenario, independent of the order and layout of rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEEDS = (1, 2)


def row_sums(df: DataFrame) -> list[Column]:
    """Count and two sums of row hashes: they change with any row, not with the order of rows.

    Repeated rows count as often as they occur. Columns are hashed by name.
    """
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")) for seed in _SEEDS]
    return [F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[s.cast("string") for s in sums]).alias("sums")]


def by_scenario(tables: Mapping[str, DataFrame], common: Column | None = None) -> DataFrame:
    """scenario, fingerprint: of all rows of a scenario in all tables, and of ``common``.

    Each table is summed by scenario before anything is shuffled. ``common`` is text that
    every scenario depends on, such as parameters.
    """
    parts = [
        df.groupBy("scenario").agg(*row_sums(df)).select("scenario", F.lit(title).alias("title"), "sums")
        for title, df in tables.items()
    ]
    listed = F.sort_array(F.collect_list(F.concat_ws("=", "title", "sums")))  # one for each title
    text = F.concat_ws("\n", listed, F.lit("") if common is None else common)
    return reduce(DataFrame.unionByName, parts).groupBy("scenario").agg(F.sha2(text, 256).alias("fingerprint"))


def of_table(df: DataFrame) -> str:
    """One fingerprint over all rows of a table."""
    return df.agg(*row_sums(df)).first()[0]
