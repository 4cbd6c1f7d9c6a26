"""Upstream CO2, primary energy and non-CO2 emissions per unit of fuel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.numeric import ieee_div, round_nearest, strict_sum
from wellspring.operators.upstream import GHG, PRIMARY
from wellspring.params import LcaParams
from wellspring.sources.mappings import Mappings

FUEL = ["fuel", "scenario", "year"]


def primary_inputs(absorbed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Primary commodities a fuel takes up, over all depths."""
    return _total(absorbed, PRIMARY, "sector", "EJ_in", by)


def nonco2_emissions(absorbed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Non-CO2 gases emitted for a fuel, over all depths."""
    return _total(absorbed, GHG, "GHG", "TG", by)


def _total(
    absorbed: DataFrame, kind: str, name: str, measure: str, by: Sequence[str]
) -> DataFrame:
    return (
        absorbed.where(F.col("kind") == kind)
        .groupBy(*FUEL, *by, F.col("commodity").alias(name))
        .agg(strict_sum(F.col("value")).alias(measure))
    )


def upstream_co2(
    absorbed: DataFrame, production: DataFrame, m: Mappings, by: Sequence[str] = ()
) -> DataFrame:
    """Upstream kg CO2 per GJ by reporting fuel, less the carbon reported at the tailpipe.

    Emissions are summed straight from the absorbed rows, in a single shuffle; primary
    energy and other gases likewise.
    """
    spark = absorbed.sparkSession
    factors = m.frame(spark, "co2_ef", "sector", "CO2_kgGJ")
    mass = (
        absorbed.where(F.col("kind") == PRIMARY)
        .join(factors, F.col("commodity") == F.col("sector"), "left")
        .groupBy(*FUEL, *by)
        .agg(strict_sum(F.col("value") * F.col("CO2_kgGJ")).alias("MtCO2"))
    )
    pooled = _pool(mass, production, m, "MtCO2", by)
    tailpipe = m.frame(spark, "fuel_techs", "reporting_fuel", "kgCO2_GJ")
    return pooled.join(tailpipe, "reporting_fuel", "left").select(
        F.col("reporting_fuel").alias("fuel"),
        "scenario",
        "year",
        *by,
        (ieee_div(F.col("MtCO2"), F.col("EJ_out")) - F.col("kgCO2_GJ")).alias("kgCO2_GJ"),
    )


def primary_energy(
    absorbed: DataFrame,
    production: DataFrame,
    m: Mappings,
    p: LcaParams,
    by: Sequence[str] = (),
) -> DataFrame:
    """Primary energy in per unit of fuel out, by reporting fuel and primary fuel."""
    names = m.frame(absorbed.sparkSession, "co2_ef", "sector", "Primary_fuel")
    energy = (
        absorbed.where(F.col("kind") == PRIMARY)
        .join(names, F.col("commodity") == F.col("sector"), "left")
        .where(F.col("Primary_fuel").isNotNull())
        .groupBy(*FUEL, *by, "Primary_fuel")
        .agg(strict_sum(F.col("value")).alias("EJ_in"))
    )
    pooled = _pool(energy, production, m, "EJ_in", [*by, "Primary_fuel"])
    ratio = ieee_div(F.col("EJ_in"), F.col("EJ_out"))
    return pooled.select(
        F.col("reporting_fuel").alias("fuel"),
        "scenario",
        "year",
        *by,
        "Primary_fuel",
        round_nearest(ratio, p.digits).alias("IO"),
    )


def upstream_nonco2(
    absorbed: DataFrame, production: DataFrame, m: Mappings, by: Sequence[str] = ()
) -> DataFrame:
    """Upstream kg CO2-equivalent per GJ by reporting fuel and gas."""
    gwp = m.frame(absorbed.sparkSession, "nonco2_gwp")
    mass = (
        absorbed.where(F.col("kind") == GHG)
        .withColumnRenamed("commodity", "GHG")
        .join(gwp, "GHG", "left")
        .groupBy(*FUEL, *by, "GHG")
        .agg(strict_sum(F.col("value") * F.col("GWP")).alias("MtCO2e"))
    )
    pooled = _pool(mass, production, m, "MtCO2e", [*by, "GHG"])
    return pooled.select(
        F.col("reporting_fuel").alias("fuel"),
        "scenario",
        "year",
        *by,
        "GHG",
        ieee_div(F.col("MtCO2e"), F.col("EJ_out")).alias("kgCO2e_GJ"),
    )


def _pool(
    per_fuel: DataFrame, production: DataFrame, m: Mappings, measure: str, by: Sequence[str]
) -> DataFrame:
    """Sum a measure and the output of its fuels over each reporting fuel.

    Output is counted only for fuels that have a row of the measure, so a reporting fuel's
    denominator may differ between primary fuels or gases.
    """
    reporting = m.frame(per_fuel.sparkSession, "fuel_techs", "fuel", "reporting_fuel")
    return (
        per_fuel.join(production, FUEL, "left")
        .join(reporting, "fuel", "left")
        .groupBy("reporting_fuel", "scenario", "year", *by)
        .agg(
            strict_sum(F.col(measure)).alias(measure),
            strict_sum(F.col("EJ_out")).alias("EJ_out"),
        )
    )
