"""Summary tables over the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.numeric import missing, strict_sum
from wellspring.params import LcaParams


def bar_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Length of each bar segment: the sum of its present values."""
    return df.where(~missing(F.col(value))).groupBy(*keys).agg(F.sum(value).alias(value))


def base_ghg(ghg: DataFrame, p: LcaParams) -> DataFrame:
    """Base scenario by fuel, year and source, with a label per bar."""
    base = ghg.where(F.col("scenario") == p.base_scenario)
    totals = bar_totals(base, ["fuel", "year", "source"], "kgCO2e_GJ")
    label = F.concat_ws(" ", F.coalesce("fuel", F.lit("NA")), F.col("year").cast("string"))
    return totals.select(label.alias("label"), "fuel", "year", "source", "kgCO2e_GJ")


def highlighted_ghg(ghg: DataFrame, p: LcaParams) -> DataFrame:
    """The highlighted fuels over all scenarios and years."""
    chosen = ghg.where(F.col("fuel").isin(*p.highlighted_fuels))
    return bar_totals(chosen, ["scenario", "fuel", "year", "source"], "kgCO2e_GJ")


def final_year_ghg(ghg: DataFrame, p: LcaParams) -> DataFrame:
    """Base scenario in the final year."""
    return bar_totals(_final_base(ghg, p), ["fuel", "source"], "kgCO2e_GJ")


def final_year_primary_energy(energy: DataFrame, p: LcaParams) -> DataFrame:
    return bar_totals(_final_base(energy, p), ["fuel", "Primary_fuel"], "IO")


def contrasted_primary_energy(energy: DataFrame, p: LcaParams) -> DataFrame:
    """Highlighted fuels in the final year for the scenarios being contrasted."""
    chosen = energy.where(
        F.col("scenario").rlike(p.contrasted_scenarios)
        & (F.col("year") == p.final_year)
        & F.col("fuel").isin(*p.highlighted_fuels)
    )
    return bar_totals(chosen, ["scenario", "fuel", "Primary_fuel"], "IO")


def price_lines(prices: DataFrame) -> DataFrame:
    """Price of each reporting fuel over the years, one line per scenario."""
    return prices.select("scenario", "reporting_fuel", "year", "price_USDperGJ")


def depth_totals(ghg_by_depth: DataFrame, p: LcaParams) -> DataFrame:
    """Total intensity by fuel and recursion depth in the sensitivity year."""
    excluded = F.coalesce(F.col("fuel").isin(*p.sensitivity_excluded), F.lit(False))
    kept = ghg_by_depth.where((F.col("year") == p.sensitivity_year) & ~excluded)
    return kept.groupBy("scenario", "fuel", "RD").agg(
        strict_sum(F.col("kgCO2e_GJ")).alias("kgCO2e_GJ")
    )


def _final_base(df: DataFrame, p: LcaParams) -> DataFrame:
    return df.where((F.col("scenario") == p.base_scenario) & (F.col("year") == p.final_year))
