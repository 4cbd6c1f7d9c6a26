"""Yearly series: fill out the year grid and interpolate inside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.numeric import missing


def complete_years(
    df: DataFrame, keys: Sequence[str], value: str, years: Sequence[int]
) -> DataFrame:
    """One row per key and grid year, NULL where the series has no value.

    Values sharing a key and year are averaged. A key's points are packed into a map
    that holds at most one entry per grid year, then unpacked over the grid, so the
    result stays hash partitioned by the keys and a window over them needs no shuffle.
    """
    points = (
        df.where(F.col("year").isin(*years))
        .groupBy(*keys, "year")
        .agg(F.avg(F.when(~missing(F.col(value)), F.col(value))).alias(value))
    )
    packed = points.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("year", value))).alias("_points")
    )
    grid = F.array(*[F.lit(int(y)) for y in years])
    return packed.withColumn("year", F.explode(grid)).select(
        *keys, "year", F.try_element_at("_points", F.col("year")).alias(value)
    )


def interpolate_linear(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Linear interpolation over ``year`` within each key; NULL outside the known span."""
    ordered = Window.partitionBy(*keys).orderBy("year")
    before = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known_value = F.when(~missing(F.col(value)), F.col(value))
    known_year = F.when(known_value.isNotNull(), F.col("year"))

    x0, y0 = (F.last(c, ignorenulls=True).over(before) for c in (known_year, known_value))
    x1, y1 = (F.first(c, ignorenulls=True).over(after) for c in (known_year, known_value))
    spans = df.select(
        *keys, "year", x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1")
    )
    share = F.try_divide(F.col("year") - F.col("_x0"), F.col("_x1") - F.col("_x0"))
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * share
    return spans.select(
        *keys,
        "year",
        F.when(F.col("_x0") == F.col("_x1"), F.col("_y0")).otherwise(line).alias(value),
    )
