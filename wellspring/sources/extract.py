"""Selections that turn raw model output into the fact tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring import fixed_values as fv
from wellspring.functions.numeric import strict_sum


def in_region(df: DataFrame, region: str | None) -> DataFrame:
    if region is None or "region" not in df.columns:
        return df
    return df.where(F.col("region") == region)


def in_regions(df: DataFrame, regions: Iterable[str] | None) -> DataFrame:
    return df if regions is None else df.where(F.col("region").isin(*regions))


def emitted_gases(df: DataFrame, gases: Iterable[str] | None = fv.EMITTED_GASES) -> DataFrame:
    return df if gases is None else df.where(F.col("ghg").isin(*gases))


def without_agricultural_supply(df: DataFrame, type_column: str = "sector_type") -> DataFrame:
    """Costs of agricultural supply sectors carry no meaning and are left out."""
    if type_column not in df.columns:
        return df
    return df.where(~F.col(type_column).eqNullSafe(fv.AGRICULTURAL_SUPPLY))


def carbon_markets(df: DataFrame, word: str = "CO2") -> DataFrame:
    return df.where(F.col("market").contains(word))


def between_years(df: DataFrame, after: int = 2015, before: int = 2055) -> DataFrame:
    return df.where((F.col("year") > after) & (F.col("year") < before))


def sum_land_leaves(df: DataFrame) -> DataFrame:
    """Land-use change emissions of a region, summed over its land leaves."""
    return df.groupBy("scenario", "region", "year").agg(strict_sum(F.col("value")).alias("value"))


def land_use(df: DataFrame, leaf_column: str = "LandLeaf") -> DataFrame:
    """Land-use change by region within the year bounds, from rows by region or by land leaf."""
    rows = between_years(df)
    return sum_land_leaves(rows) if leaf_column in df.columns else rows
