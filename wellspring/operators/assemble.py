"""Sources of emissions put together, and scenario codes spelled out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.numeric import missing, round_nearest
from wellspring.functions.text import code_pieces, last_chars, lookup
from wellspring.params import LcaParams
from wellspring.sources.mappings import Mappings


def tag_co2(df: DataFrame, stage: str) -> DataFrame:
    """Label CO2 intensities with gas and source."""
    return (
        df.withColumnRenamed("kgCO2_GJ", "kgCO2e_GJ")
        .withColumn("GHG", F.lit("CO2"))
        .withColumn("source", F.lit(f"{stage} CO2"))
    )


def tag_nonco2(df: DataFrame, stage: str) -> DataFrame:
    return df.withColumn("source", F.concat(F.lit(f"{stage} "), F.col("GHG")))


def greet_shift(m: Mappings, p: LcaParams) -> tuple[list[str], float]:
    """Fuels whose CO2 is shifted from tailpipe to upstream, and by how much."""
    techs = m.records("fuel_techs")
    fuels = [
        r["reporting_fuel"]
        for r in techs
        if r["sector"] == p.greet_sector and r["kgCO2_GJ"] == 0
    ]
    sizes = [r["kgCO2_GJ"] for r in techs if r["fuel"] == p.greet_fossil_fuel]
    if len(sizes) != 1:
        raise ValueError(f"fuel_techs: fuel {p.greet_fossil_fuel!r} must be listed")
    return list(dict.fromkeys(fuels)), sizes[0]


def greet_convention(
    upstream: DataFrame, tailpipe: DataFrame, m: Mappings, p: LcaParams
) -> tuple[DataFrame, DataFrame]:
    """Count the CO2 bound in carbon-based fuels upstream and release it at the tailpipe."""
    if not p.greet_convention:
        return upstream, tailpipe
    fuels, size = greet_shift(m, p)

    def shifted(df: DataFrame, by: float) -> DataFrame:
        c = F.col("kgCO2e_GJ")
        chosen = F.when(F.col("fuel").isin(*fuels), c + F.lit(by)).otherwise(c)
        return df.withColumn("kgCO2e_GJ", chosen)

    return shifted(upstream, -size), shifted(tailpipe, size)


def add_luc(upstream: DataFrame, luc: DataFrame, p: LcaParams) -> DataFrame:
    """Add land-use change to upstream CO2 where it is known for the fuel and policy."""
    c, extra = F.col("kgCO2e_GJ"), F.col("LUC_kgCO2_GJ")
    return (
        upstream.withColumn("Policy", last_chars(F.col("scenario"), p.policy_width))
        .join(luc, ["fuel", "Policy"], "left")
        .withColumn("kgCO2e_GJ", F.when(missing(extra), c).otherwise(c + extra))
        .drop("Policy", "LUC_kgCO2_GJ")
    )


def lca_ghg(
    upstream_co2: DataFrame,
    upstream_nonco2: DataFrame,
    tailpipe_co2: DataFrame,
    tailpipe_nonco2: DataFrame,
    luc: DataFrame,
    m: Mappings,
    p: LcaParams,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Emission intensities of all sources in one table.

    ``by`` names columns that the upstream tables carry in addition; the tailpipe tables
    must carry them too.
    """
    up, tail = greet_convention(
        tag_co2(upstream_co2, "Upstream"), tag_co2(tailpipe_co2, "Tailpipe"), m, p
    )
    parts = [
        add_luc(up, luc, p),
        tag_nonco2(upstream_nonco2, "Upstream"),
        tail,
        tag_nonco2(tailpipe_nonco2, "Tailpipe"),
    ]
    columns = ["scenario", "fuel", "GHG", "source", "year", *by, "kgCO2e_GJ"]
    rows = parts[0].select(*columns)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*columns))
    return rows.withColumn("kgCO2e_GJ", round_nearest(F.col("kgCO2e_GJ"), p.digits))


def decode_scenario(df: DataFrame, m: Mappings, p: LcaParams) -> DataFrame:
    """Add a column per scenario dimension, after ``scenario``, with the level's description.

    A level defined twice takes its first description; an undefined level gives NULL.
    """
    definitions = m.records("scenario_definitions")
    levels: dict[str, str | None] = {}
    for r in definitions:
        levels.setdefault(r["string"], r["description"])
    variables = list(dict.fromkeys(r["variable_name"] for r in definitions))
    pieces = code_pieces(F.col("scenario"), p.code_cuts)
    if len(variables) != len(pieces):
        raise ValueError(f"{len(p.code_cuts)} cuts do not give {len(variables)} dimensions")
    decoded = [lookup(c, levels).alias(v) for v, c in zip(variables, pieces)]
    at = df.columns.index("scenario") + 1
    return df.select(*df.columns[:at], *decoded, *df.columns[at:])
