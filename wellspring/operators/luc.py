"""Land-use change CO2 per unit of additional biofuel.

Land-use runs are named ``<prefix>_<biofuel level>_<policy>``. Within a policy, the run
without additional biofuel is the base that the others are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.numeric import ieee_div, strict_sum, sum_present
from wellspring.functions.series import complete_years, interpolate_linear
from wellspring.functions.text import name_piece
from wellspring.operators.flows import primary_outputs
from wellspring.params import LcaParams
from wellspring.sources.extract import in_regions
from wellspring.sources.mappings import Mappings


def luc_interpolated(luc_by_region: DataFrame, p: LcaParams) -> DataFrame:
    """Yearly land-use change carbon per run, summed over regions, gaps filled linearly."""
    totals = (
        in_regions(luc_by_region, p.luc_regions)
        .where(F.col("year").isin(*p.luc_years))
        .groupBy("scenario", "year")
        .agg(strict_sum(F.col("value")).alias("luc"))
    )
    grid = complete_years(totals, ["scenario"], "luc", p.luc_years)
    return interpolate_linear(grid, ["scenario"], "luc")


def biofuel_interpolated(luc_outputs_by_tech: DataFrame, m: Mappings, p: LcaParams) -> DataFrame:
    """Yearly output per run of the reporting fuels with land-use change."""
    spark = luc_outputs_by_tech.sparkSession
    techs = m.frame(
        spark,
        "fuel_techs",
        "sector",
        "subsector",
        "technology",
        "fuel",
        "reporting_fuel",
        "luc_fuel",
    ).where(F.col("luc_fuel").isNotNull())
    keys = ["scenario", "reporting_fuel", "luc_fuel"]
    totals = (
        primary_outputs(luc_outputs_by_tech, p, p.luc_years)
        .join(techs, ["sector", "subsector", "technology"])
        .groupBy(*keys, "year")
        .agg(strict_sum(F.col("value")).alias("Fuel_EJ"))
    )
    return interpolate_linear(complete_years(totals, keys, "Fuel_EJ", p.luc_years), keys, "Fuel_EJ")


def cumulative_luc(luc: DataFrame) -> DataFrame:
    """Carbon over all years; NULL when the known years do not span the grid."""
    total = luc.groupBy("scenario").agg(strict_sum(F.col("luc")).alias("luc"))
    return total.select(*_run_name(), "luc")


def cumulative_biofuel(biofuel: DataFrame) -> DataFrame:
    """Output over the years that are known or interpolated."""
    total = biofuel.groupBy("scenario", "reporting_fuel", F.col("luc_fuel").alias("_for")).agg(
        sum_present(F.col("Fuel_EJ")).alias("Fuel_EJ")
    )
    return total.select("reporting_fuel", *_run_name(), "Fuel_EJ")


def _run_name():
    return name_piece(F.col("scenario"), 1).alias("luc_fuel"), name_piece(
        F.col("scenario"), 2
    ).alias("Policy")


def _against_base(runs: DataFrame, keys: list[str], value: str, p: LcaParams) -> DataFrame:
    """Runs other than the base, their value less that of the base run with the same keys."""
    is_base = F.col("luc_fuel") == p.luc_base
    base = F.max(F.when(is_base, F.col(value))).over(Window.partitionBy(*keys))
    return runs.withColumn(value, F.col(value) - base).where(~is_base)


def luc_intensity(luc: DataFrame, biofuel: DataFrame, m: Mappings, p: LcaParams) -> DataFrame:
    """Additional land-use CO2 over additional biofuel: fuel, Policy, LUC_kgCO2_GJ."""
    spark = luc.sparkSession
    pairs = m.frame(spark, "fuel_techs", "reporting_fuel", "luc_fuel")
    pairs_with_luc = pairs.where(F.col("luc_fuel").isNotNull())

    added_carbon = (
        _against_base(cumulative_luc(luc), ["Policy"], "luc", p)
        .join(pairs_with_luc, "luc_fuel", "left")
        .select("reporting_fuel", "Policy", (F.col("luc") * F.lit(p.carbon_to_co2)).alias("LUC_MtCO2e"))
    )
    added_fuel = (
        _against_base(cumulative_biofuel(biofuel), ["Policy", "reporting_fuel"], "Fuel_EJ", p)
        .join(pairs, ["reporting_fuel", "luc_fuel"], "left_semi")
        .select("reporting_fuel", "Policy", "Fuel_EJ")
    )
    return added_carbon.join(added_fuel, ["reporting_fuel", "Policy"], "left").select(
        F.col("reporting_fuel").alias("fuel"),
        "Policy",
        ieee_div(F.col("LUC_MtCO2e"), F.col("Fuel_EJ")).alias("LUC_kgCO2_GJ"),
    )
