"""Column names and types of the fact, mapping and result tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"year": T.IntegerType(), "value": T.DoubleType()}


def _facts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES.get(n, T.StringType())) for n in names])


_TECH = ("scenario", "region", "sector", "subsector")

# Fact tables by query title. Titles name the folder a table is stored in.
FACTS: dict[str, T.StructType] = {
    "outputs by tech": _facts("Units", *_TECH, "output", "technology", "year", "value"),
    "inputs by tech": _facts("Units", *_TECH, "technology", "input", "year", "value"),
    "CO2 sequestration by tech": _facts("Units", *_TECH, "technology", "year", "value"),
    "NonCO2 GHG emissions by tech": _facts("Units", *_TECH, "technology", "ghg", "year", "value"),
    "prices by sector": _facts("Units", "scenario", "region", "sector", "year", "value"),
    "costs by tech": _facts("Units", *_TECH, "technology", "year", "value"),
    "CO2 prices": _facts("Units", "scenario", "market", "year", "value"),
    "LUC emissions by region": _facts("Units", "scenario", "region", "year", "value"),
}


# Columns that a fact table may have besides: a selection is made by them when they are there.
OPTIONAL = {"costs by tech": ("sector_type",), "LUC emissions by region": ("LandLeaf",)}


def _table(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

# Mapping tables by the name of the CSV file that holds them.
MAPPINGS: dict[str, T.StructType] = {
    "fuel_techs": _table(
        sector=_S, subsector=_S, technology=_S, fuel=_S, reporting_fuel=_S, kgCO2_GJ=_D, luc_fuel=_S
    ),
    "co2_ef": _table(sector=_S, Primary_fuel=_S, CO2_kgGJ=_D),
    "nonco2_gwp": _table(GHG=_S, GWP=_D),
    "fuel_delivery_cost": _table(sector=_S, delivery_cost=_S),
    "scenario_definitions": _table(string=_S, variable_name=_S, description=_S),
}

# Results before the scenario code is decoded into one column per dimension.
RESULTS: dict[str, T.StructType] = {
    "fuels_lca_ghg": _table(scenario=_S, fuel=_S, GHG=_S, source=_S, year=_I, kgCO2e_GJ=_D),
    "fuels_primary_energy": _table(fuel=_S, scenario=_S, year=_I, Primary_fuel=_S, IO=_D),
    "fuels_prices": _table(scenario=_S, reporting_fuel=_S, year=_I, price_USDperGJ=_D),
}


def require_columns(df: DataFrame, names: Iterable[str], table: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"{table}: missing column(s) {', '.join(absent)}")


def conform(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Select the schema's columns with its types; name every absent column."""
    require_columns(df, schema.names, table)
    further = [n for n in OPTIONAL.get(table, ()) if n in df.columns]
    columns = [df[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*columns, *[df[f"`{n}`"].cast(T.StringType()).alias(n) for n in further])


def check_result(df: DataFrame, table: str) -> DataFrame:
    """Fail unless a result table has its columns with their types."""
    require_columns(df, RESULTS[table].names, table)
    wrong = [f.name for f in RESULTS[table] if df.schema[f.name].dataType != f.dataType]
    if wrong:
        raise TypeError(f"{table}: unexpected type of column(s) {', '.join(wrong)}")
    return df
