"""Outputs, inputs and input-output coefficients by technology and by sector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring import fixed_values as fv
from wellspring.functions.numeric import ieee_div, strict_sum
from wellspring.functions.text import drop_first
from wellspring.params import LcaParams
from wellspring.sources.extract import emitted_gases, in_region

TECH_KEYS = ["scenario", "sector", "subsector", "technology", "year"]
SECTOR_KEYS = ["scenario", "sector", "year"]


def clean_outputs(outputs_by_tech: DataFrame, p: LcaParams) -> DataFrame:
    """Primary output of each technology in the analysis years; by-products are dropped."""
    return primary_outputs(outputs_by_tech, p, p.years).select(*TECH_KEYS, "value")


def primary_outputs(outputs_by_tech: DataFrame, p: LcaParams, years) -> DataFrame:
    return in_region(outputs_by_tech, p.region).where(
        (F.col("output") == F.col("sector")) & F.col("year").isin(*years)
    )


def sector_totals(df: DataFrame, *extra: str) -> DataFrame:
    """Sum of ``value`` by scenario, sector and year (and further columns)."""
    return df.groupBy("scenario", "sector", *extra, "year").agg(
        strict_sum(F.col("value")).alias("value")
    )


def clean_inputs(inputs_by_tech: DataFrame, p: LcaParams) -> DataFrame:
    """Inputs in the analysis years, without water and oil credits."""
    return (
        in_region(inputs_by_tech, p.region)
        .where(
            ~F.col("input").contains(fv.WATER_WORD)
            & (F.col("input") != fv.OIL_CREDITS)
            & F.col("year").isin(*p.years)
        )
        .select(*TECH_KEYS, "input", "value")
    )


def hydro_inputs(outputs_tech: DataFrame) -> DataFrame:
    """Hydropower reports no input, so its output stands in as the resource used."""
    return outputs_tech.where(F.col("technology") == fv.HYDRO_TECHNOLOGY).select(
        *TECH_KEYS, F.lit(fv.HYDRO_COMMODITY).alias("input"), "value"
    )


def storage_inputs(co2_sequestration_by_tech: DataFrame, p: LcaParams) -> DataFrame:
    """Stored carbon, treated as an input so that it is attributed upstream."""
    return (
        in_region(co2_sequestration_by_tech, p.region)
        .where(F.col("year").isin(*p.years))
        .select(*TECH_KEYS, F.lit(fv.STORAGE_COMMODITY).alias("input"), "value")
    )


def nonco2_inputs(nonco2_by_tech: DataFrame, p: LcaParams) -> DataFrame:
    """Non-CO2 emissions as inputs; agricultural N2O is counted as N2O."""
    gas = drop_first(F.col("ghg"), fv.AGRICULTURAL_SUFFIX)
    return (
        emitted_gases(in_region(nonco2_by_tech, p.region), p.emitted_gases)
        .where(F.col("year").isin(*p.years))
        .select(*TECH_KEYS, gas.alias("input"), "value")
    )


def assemble_inputs(
    inputs_by_tech: DataFrame,
    outputs_tech: DataFrame,
    co2_sequestration_by_tech: DataFrame,
    nonco2_by_tech: DataFrame,
    p: LcaParams,
) -> DataFrame:
    """All flows into a technology: energy, hydropower, stored carbon, non-CO2 gases."""
    parts = [
        clean_inputs(inputs_by_tech, p),
        hydro_inputs(outputs_tech),
        storage_inputs(co2_sequestration_by_tech, p),
        nonco2_inputs(nonco2_by_tech, p),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def io_coefficients(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Input per unit of output. Inputs without an output keep a NULL coefficient."""
    joined = inputs.withColumnRenamed("value", "_input").join(
        outputs.select(*keys, F.col("value").alias("_output")), keys, "left"
    )
    return joined.select(
        *keys, "input", ieee_div(F.col("_input"), F.col("_output")).alias("value")
    )
