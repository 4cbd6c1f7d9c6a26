"""Delivery costs, carbon penalties and output-weighted fuel prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.numeric import fill_missing, ieee_div, round_nearest, strict_sum
from wellspring.operators.flows import TECH_KEYS
from wellspring.operators.upstream import fuel_technologies
from wellspring.params import LcaParams
from wellspring.sources.extract import in_region, without_agricultural_supply
from wellspring.sources.mappings import Mappings


def delivery_costs(prices_by_sector: DataFrame, m: Mappings, p: LcaParams) -> DataFrame:
    """Delivered price less the price at the production sector."""
    mapping = m.frame(prices_by_sector.sparkSession, "fuel_delivery_cost").withColumnRenamed(
        "delivery_cost", "_delivered"
    )
    prices = in_region(prices_by_sector, p.region).where(F.col("year").isin(*p.years))
    produced = prices.where(F.col("sector").isin(*m.column("fuel_delivery_cost", "sector")))
    delivered = prices.where(
        F.col("sector").isin(*m.column("fuel_delivery_cost", "delivery_cost"))
    ).select(
        "scenario",
        F.col("sector").alias("_delivered"),
        "year",
        F.col("value").alias("_delivered_price"),
    )
    return (
        produced.join(mapping, "sector", "left")
        .join(delivered, ["scenario", "_delivered", "year"], "left")
        .select(
            "scenario",
            "sector",
            "year",
            (F.col("_delivered_price") - F.col("value")).alias("delivery_cost"),
        )
    )


def co2_penalties(co2_prices: DataFrame, p: LcaParams) -> DataFrame:
    """Carbon prices as 2020 dollars per kg of CO2."""
    price = F.col("value") * F.lit(p.usd_1990_to_2020) / F.lit(p.carbon_to_co2) / F.lit(1000.0)
    return co2_prices.where(F.col("market") == p.carbon_market).select(
        "scenario", "year", price.alias("USD_kgCO2")
    )


def fuel_prices(
    costs_by_tech: DataFrame,
    delivery: DataFrame,
    penalties: DataFrame,
    outputs_tech: DataFrame,
    m: Mappings,
    p: LcaParams,
) -> DataFrame:
    """Price of each reporting fuel, weighted by the output of its technologies."""
    techs = m.frame(
        costs_by_tech.sparkSession,
        "fuel_techs",
        "sector",
        "subsector",
        "technology",
        "fuel",
        "reporting_fuel",
        "kgCO2_GJ",
    )
    weights = fuel_technologies(outputs_tech, m).withColumnRenamed("value", "_quantity")
    filled = (
        without_agricultural_supply(in_region(costs_by_tech, p.region))
        .where(F.col("year").isin(*p.years))
        .join(techs, ["sector", "subsector", "technology"])
        .join(delivery, ["scenario", "sector", "year"], "left")
        .join(penalties, ["scenario", "year"], "left")
        .join(weights, TECH_KEYS, "left")
        .select(
            "scenario",
            "reporting_fuel",
            "year",
            "value",
            "kgCO2_GJ",
            fill_missing(F.col("delivery_cost"), 0.0).alias("delivery"),
            fill_missing(F.col("USD_kgCO2"), 0.0).alias("penalty"),
            fill_missing(F.col("_quantity"), 0.0).alias("quantity"),
        )
    )
    price = (F.col("value") + F.col("delivery")) * F.lit(p.usd_1975_to_2020) + (
        F.col("kgCO2_GJ") * F.col("penalty")
    )
    return (
        filled.groupBy("scenario", "reporting_fuel", "year")
        .agg(
            strict_sum(price * F.col("quantity")).alias("_spent"),
            strict_sum(F.col("quantity")).alias("_bought"),
        )
        .select(
            "scenario",
            "reporting_fuel",
            "year",
            round_nearest(ieee_div(F.col("_spent"), F.col("_bought")), p.digits).alias(
                "price_USDperGJ"
            ),
        )
    )
