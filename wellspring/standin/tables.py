"""Fact tables derived from an order/lineitem star schema.

The customer's nation is the consuming sector, the supplier's nation the input, the part
type the technology. All facts are sums over one five-way join, so that join runs once.
Grouping sets sum it by technology, by technology and input, and by land-use run; each set
has a number of groups that does not grow with the data, so most of the summing happens
before the shuffle. The sums are written once, one folder per set, and facts are read from
there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring import fixed_values as fv
from wellspring.functions.numeric import ieee_div
from wellspring.functions.text import lookup
from wellspring.sources.tables import FactTables
from wellspring.sources.workspace import materialize
from wellspring.standin.config import LUC_LEVELS, SEGMENTS, URGENT, YEARS, luc_year

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_type string, p_retailprice double",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# Grouping sets: by technology and input, by technology, by land-use run.
KEYS = {
    "inputs": ["segment", "policy", "year", "consumer", "p_type", "producer"],
    "techs": ["segment", "policy", "year", "consumer", "p_type", "l_returnflag"],
    "runs": ["o_orderstatus", "policy", "year", "consumer", "p_type", "l_returnflag"],
}

KEY_COLUMNS = sorted({k for keys in KEYS.values() for k in keys} - {"year"})

# Groups of facts that a query may need, and the grouping sets they are read from.
OUTPUTS, FLOWS, PRICES, LUC = "outputs", "flows", "prices", "luc"
ALL = (FLOWS, PRICES, LUC)
SETS = {
    OUTPUTS: ("techs",),
    FLOWS: ("inputs", "techs"),
    PRICES: ("techs",),
    LUC: ("runs",),
}


def sets_of(need: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(s for group in need for s in SETS[group]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class Only:
    """Scenarios (a pattern of their codes) and years that a query needs of the main runs."""

    scenarios: str = ""
    years: tuple[int, ...] = YEARS

    @property
    def codes(self) -> list[tuple[str, int]]:
        """Segment and policy of every scenario that matches."""
        return [
            (s, policy)
            for k, s in enumerate(SEGMENTS, 1)
            for policy in (1, 2)
            if re.search(self.scenarios, f"m{k}p{policy}")
        ]


def base(spark: SparkSession, sf_dir: str, only: Only = Only()) -> DataFrame:
    """One row per order line with its consuming and producing nation.

    What ``only`` leaves out is filtered in the scans of customers and orders. A pattern that
    is no product of segments and policies lets some other scenarios through.

    A supplier, part, customer or order with very many lines is left to adaptive execution,
    which splits a skewed side of a shuffled join.
    """

    segments = list(dict.fromkeys(s for s, _ in only.codes))
    policies = {p for _, p in only.codes}
    urgent = F.coalesce(F.col("o_orderpriority").isin(*URGENT), F.lit(False))
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", segment.cast("int").alias("segment"), F.col("c_nationkey").alias("consumer"), "c_mktsegment"
    )
    if only.scenarios:
        customers = customers.where(F.col("c_mktsegment").isin(*segments))
    customers = customers.drop("c_mktsegment")
    date = F.col("o_orderdate")
    dated = table(spark, sf_dir, "orders").where(
        (date >= F.lit(datetime(min(only.years), 1, 1)).cast("timestamp_ntz"))
        & (date < F.lit(datetime(max(only.years) + 1, 1, 1)).cast("timestamp_ntz"))
    )
    if len(policies) == 1:
        dated = dated.where(urgent if policies == {2} else ~urgent)
    orders = dated.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("c_custkey"),
        "o_orderstatus",
        F.when(F.col("o_orderpriority").isin(*URGENT), 2).otherwise(1).alias("policy"),
        F.year("o_orderdate").alias("year"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("producer")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_retailprice")
    return (
        table(spark, sf_dir, "lineitem")
        # orders grow with their lines: both are always shuffled and merged, never broadcast
        .join(orders.join(customers, "c_custkey").hint("merge"), "l_orderkey")
        .join(suppliers, "l_suppkey")
        .join(parts, "l_partkey")
    )


def sums(spark: SparkSession, sf_dir: str, need: Iterable[str] = ALL, only: Only = Only()) -> DataFrame:
    """The measures of ``base`` by each needed grouping set; ``set`` names the set."""
    wanted = sets_of(need)
    price = F.col("l_extendedprice")
    kept = F.col("l_returnflag") != "R"
    stored = kept & (F.col("l_tax") >= 0.08)
    unit = ieee_div(price, F.col("l_quantity"))
    keys = list(dict.fromkeys(k for g in wanted for k in KEYS[g]))
    measures = {"gross": price}
    if FLOWS in need:
        measures |= {
            "net": F.when(kept, price * (1 - F.col("l_discount"))),
            "stored": F.when(stored, F.col("l_tax") * price),
            "quantity": F.col("l_quantity"),
        }
    if PRICES in need:
        measures |= {"unit": unit, "retail": F.col("p_retailprice") * price}
    if LUC in need and only != Only():
        raise ValueError("land-use runs need all scenarios and years")
    rows = base(spark, sf_dir, only).select(*keys, *[c.alias(n) for n, c in measures.items()])
    totals = [F.sum(n).alias(n) for n in measures]
    if PRICES in need:
        totals += [F.count(F.lit(1)).alias("lines"), F.count("unit").alias("units")]
    if len(wanted) == 1:
        return rows.groupBy(*keys).agg(*totals).withColumn("set", F.lit(wanted[0]))
    grouped = rows.groupingSets([[F.col(k) for k in KEYS[g]] for g in wanted], *keys)
    ids = F.create_map(*[F.lit(x) for g in wanted for x in (_grouping_id(keys, KEYS[g]), g)])
    return (
        grouped.agg(F.grouping_id().alias("_id"), *totals)
        .withColumn("set", ids[F.col("_id").cast("int")])
        .drop("_id")
    )


def _grouping_id(keys: list[str], grouped: list[str]) -> int:
    return int("".join("0" if k in grouped else "1" for k in keys), 2)


def facts(spark: SparkSession, sf_dir: str, need: Iterable[str] = ALL, only: Only = Only()) -> FactTables:
    """The needed groups of facts over one written pass through the star schema."""
    return facts_from(materialize(sums(spark, sf_dir, need, only), "sums", by="set"), spark, sf_dir, need)


def facts_lazily(spark: SparkSession, sf_dir: str, need: Iterable[str] = ALL, only: Only = Only()) -> FactTables:
    """The same without a written pass, for a query that reads a fact once."""
    return facts_from(sums(spark, sf_dir, need, only), spark, sf_dir, need)


def facts_from(
    s: DataFrame, spark: SparkSession, sf_dir: str, need: Iterable[str] = ALL
) -> FactTables:
    """Facts are summed by the compact keys of their set and named afterwards."""
    found = dict.fromkeys(f.name for f in fields(FactTables))
    scenario, tech = ["segment", "policy"], ["consumer", "p_type"]
    output = F.when(F.col("l_returnflag") == "R", "byproduct").otherwise(nation("consumer"))

    def of(name: str) -> DataFrame:
        return s.where(F.col("set") == name)

    def total(df: DataFrame, keys: list[str], measure: str, scale: float) -> DataFrame:
        value = (F.sum(measure) / F.lit(scale)).alias("value")
        return named(df.groupBy(*keys, "year").agg(value))

    def mean(df: DataFrame, keys: list[str], measure: str, count: str) -> DataFrame:
        value = (F.sum(measure) / F.sum(count) / F.lit(1e3)).alias("value")
        return named(df.groupBy(*keys, "year").agg(value))

    if set(need) & {OUTPUTS, FLOWS, PRICES}:
        found["outputs_by_tech"] = total(
            of("techs").withColumn("output", output), [*scenario, *tech, "output"], "gross", 1e6
        )
    if FLOWS in need:
        net = (F.col("net") / F.lit(1e6)).alias("value")
        amount = (F.col("quantity") / F.lit(1e4)).alias("value")
        found |= {
            "inputs_by_tech": named(
                of("inputs").where(F.col("net").isNotNull()).select(*KEYS["inputs"], net)
            ),
            "co2_sequestration_by_tech": total(
                of("techs").where(F.col("stored").isNotNull()), [*scenario, *tech], "stored", 1e6
            ),
            "nonco2_by_tech": named(of("techs").select(*KEYS["techs"], amount)),
        }
    if PRICES in need:
        by_sector = mean(
            of("techs").where(F.col("units") > 0), [*scenario, "consumer"], "unit", "units"
        )
        delivered = by_sector.where(F.col("sector") == "N2").withColumns(
            {"sector": F.lit("delivered N2"), "value": F.col("value") * 1.1}
        )
        carbon = mean(of("techs"), scenario, "gross", "lines")
        markets = F.array(F.lit("USACO2"), F.lit("USACO2_LTG"))
        found |= {
            "prices_by_sector": by_sector.unionByName(delivered),
            "costs_by_tech": mean(of("techs"), [*scenario, *tech], "retail", "gross"),
            "co2_prices": carbon.drop("region").withColumn("market", F.explode(markets)),
        }
    if LUC in need:
        run = ["o_orderstatus", "policy"]
        known = of("runs").withColumns({"output": output, "year": luc_year(F.col("year"))})
        per_nation = known.groupBy(*run, "consumer", "year").agg(F.sum("gross").alias("gross"))
        found |= {
            "luc_by_region": total(
                with_region(per_nation, spark, sf_dir), [*run, "r_name"], "gross", 1e6
            ),
            "luc_outputs_by_tech": total(known, [*run, *tech, "output"], "gross", 1e6),
        }
    return FactTables(**found)


def with_region(per_nation: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return per_nation.join(nations, F.col("consumer") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )


def named(df: DataFrame) -> DataFrame:
    """Replace the compact keys of a fact by the names of its schema."""
    has, made = set(df.columns), {"Units": F.lit("EJ"), "region": F.lit("USA")}
    if "r_name" in has:
        made["region"] = F.col("r_name")
    if "segment" in has:
        made["scenario"] = code("m", "segment", "p", "policy")
    if "o_orderstatus" in has:
        level = lookup(F.col("o_orderstatus"), LUC_LEVELS)
        made["scenario"] = F.concat_ws("_", F.lit("biofuel"), level, code("p", "policy"))
    if "consumer" in has:
        made["sector"] = nation("consumer")
        made["subsector"] = F.concat(F.lit("S"), (F.col("consumer") % 5).cast("string"))
    if "p_type" in has:
        is_hydro = F.col("p_type") == "PROMO"
        made["technology"] = F.when(is_hydro, fv.HYDRO_TECHNOLOGY).otherwise(F.col("p_type"))
    if "producer" in has:
        special = {0: "water_td", 1: fv.OIL_CREDITS, 5: "delivered N2"}
        made["input"] = F.coalesce(
            *[F.when(F.col("producer") == k, v) for k, v in special.items()], nation("producer")
        )
    if "l_returnflag" in has:
        made["ghg"] = lookup(F.col("l_returnflag"), {"A": "CH4", "N": "N2O_AGR", "R": "H2"})
    return df.withColumns(made).drop(*KEY_COLUMNS, "r_name")


def code(*parts: str) -> Column:
    """Letters and numeric columns put together, such as m3p1."""
    return F.concat(*[F.lit(x) if len(x) == 1 else F.col(x).cast("string") for x in parts])


def nation(key: str) -> Column:
    return F.concat(F.lit("N"), F.col(key).cast("string"))
