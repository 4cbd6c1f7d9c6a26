"""Emissions released when a fuel is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.numeric import ieee_div, missing, strict_sum
from wellspring.operators.flows import TECH_KEYS
from wellspring.params import LcaParams
from wellspring.sources.mappings import Mappings


def tailpipe_co2(outputs_tech: DataFrame, m: Mappings, p: LcaParams) -> DataFrame:
    """Tailpipe factor of each reporting fuel for every scenario and analysis year.

    Years and factors come from the configuration, so each scenario row is unpacked over
    two literal arrays instead of being joined with them.
    """
    factors = list(
        dict.fromkeys(zip(m.column("fuel_techs", "reporting_fuel"), m.column("fuel_techs", "kgCO2_GJ")))
    )
    pairs = F.array(
        *[
            F.struct(F.lit(f).cast("string").alias("fuel"), F.lit(k).cast("double").alias("k"))
            for f, k in factors
        ]
    )
    years = F.array(*[F.lit(int(y)) for y in p.years])
    return (
        outputs_tech.select("scenario")
        .distinct()
        .withColumn("year", F.explode(years))
        .withColumn("_factor", F.explode(pairs))
        .select("_factor.fuel", "scenario", "year", F.col("_factor.k").alias("kgCO2_GJ"))
        .where(F.col("fuel").isNotNull() & F.col("scenario").isNotNull())
        .where(~missing(F.col("kgCO2_GJ")))
    )


def tailpipe_nonco2(
    inputs_tech: DataFrame, nonco2_tech: DataFrame, m: Mappings, p: LcaParams
) -> DataFrame:
    """Non-CO2 emissions of freight per unit of fuel used, by reporting fuel and gas.

    Every energy input of a technology meets every gas it emits. Both sides are summed per
    technology first, with their row counts, so the sums over all such pairs are formed
    without emitting the pairs.
    """
    spark = inputs_tech.sparkSession
    production_sector = {
        r["delivery_cost"]: r["sector"] for r in m.records("fuel_delivery_cost")
    }
    commodities = {*m.column("fuel_techs", "sector"), *production_sector}
    freight = F.col("sector").isin(*p.freight_sectors)

    renamed = m.frame(spark, "fuel_delivery_cost").select(
        F.col("delivery_cost").alias("input"), F.col("sector").alias("_produced_as")
    )
    energy = (
        inputs_tech.where(freight & F.col("input").isin(*commodities))
        .join(renamed, "input", "left")
        .withColumn("fuel_category", F.coalesce("_produced_as", "input"))
        .groupBy(*TECH_KEYS, "fuel_category")
        .agg(
            strict_sum(F.col("value")).alias("_energy"),
            F.count(F.lit(1)).alias("_energy_rows"),
        )
    )
    gases = (
        nonco2_tech.where(freight)
        .withColumnRenamed("input", "GHG")
        .join(m.frame(spark, "nonco2_gwp"), "GHG", "left")
        .groupBy(*TECH_KEYS, "GHG")
        .agg(
            strict_sum(F.col("value") * F.col("GWP")).alias("_mass"),
            F.count(F.lit(1)).alias("_mass_rows"),
        )
    )
    pooled = (
        energy.join(gases, TECH_KEYS)
        .groupBy("scenario", "fuel_category", "year", "GHG")
        .agg(
            strict_sum(F.col("_energy") * F.col("_mass_rows")).alias("fuel_EJ"),
            strict_sum(F.col("_mass") * F.col("_energy_rows")).alias("MtCO2e"),
        )
    )
    reporting = m.frame(spark, "fuel_techs", "sector", "reporting_fuel").select(
        F.col("sector").alias("fuel_category"), F.col("reporting_fuel").alias("fuel")
    )
    return pooled.join(reporting, "fuel_category", "left").select(
        "fuel",
        "scenario",
        "year",
        "GHG",
        ieee_div(F.col("MtCO2e"), F.col("fuel_EJ")).alias("kgCO2e_GJ"),
    )
