"""The fact tables of an analysis and how they are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wellspring.sources.extract import land_use
from wellspring.sources.schemas import FACTS, RESULTS, conform

LUC_TABLES = ("luc_by_region", "luc_outputs_by_tech")


@dataclass(frozen=True)
class FactTables:
    """Fact tables over all scenarios. The last two hold the land-use change runs.

    A table that the wanted results do not read may be None.
    """

    outputs_by_tech: DataFrame
    inputs_by_tech: DataFrame
    co2_sequestration_by_tech: DataFrame
    nonco2_by_tech: DataFrame
    prices_by_sector: DataFrame
    costs_by_tech: DataFrame
    co2_prices: DataFrame
    luc_by_region: DataFrame
    luc_outputs_by_tech: DataFrame

    @classmethod
    def read(
        cls,
        spark: SparkSession,
        roots: Sequence[str],
        luc_roots: Sequence[str],
        format: str = "parquet",
    ) -> FactTables:
        """Read blocks of scenarios; a root holds one folder per query title."""

        def fact(title: str, where: Sequence[str] = roots) -> DataFrame:
            return read_fact(spark, where, title, format)

        return cls(
            outputs_by_tech=fact("outputs by tech"),
            inputs_by_tech=fact("inputs by tech"),
            co2_sequestration_by_tech=fact("CO2 sequestration by tech"),
            nonco2_by_tech=fact("NonCO2 GHG emissions by tech"),
            prices_by_sector=fact("prices by sector"),
            costs_by_tech=fact("costs by tech"),
            co2_prices=fact("CO2 prices"),
            luc_by_region=land_use(fact("LUC emissions by region", luc_roots)),
            luc_outputs_by_tech=fact("outputs by tech", luc_roots),
        )

    def where(self, condition) -> FactTables:
        """Keep the scenarios of the main runs that satisfy a condition."""
        kept = {
            f.name: getattr(self, f.name).where(condition)
            for f in fields(self)
            if f.name not in LUC_TABLES and getattr(self, f.name) is not None
        }
        return replace(self, **kept)

    def of_scenarios(self, scenarios: DataFrame) -> FactTables:
        """Keep the scenarios of the main runs that ``scenarios`` lists."""
        names = scenarios.select("scenario").distinct()
        kept = {
            f.name: getattr(self, f.name).join(names, "scenario", "left_semi")
            for f in fields(self)
            if f.name not in LUC_TABLES and getattr(self, f.name) is not None
        }
        return replace(self, **kept)

    @property
    def spark(self) -> SparkSession:
        return next(t.sparkSession for f in fields(self) if (t := getattr(self, f.name)) is not None)

    def scenario(self, name: str) -> FactTables:
        return self.where(F.col("scenario") == name)

    def scenarios_like(self, pattern: str) -> FactTables:
        return self.where(F.col("scenario").rlike(pattern))


def folder_of(title: str) -> str:
    return title.replace(" ", "_")


def read_fact(
    spark: SparkSession, roots: Sequence[str], title: str, format: str = "parquet"
) -> DataFrame:
    """One query title over all blocks, with the declared columns and types."""
    blocks = [_read_block(spark, f"{r.rstrip('/')}/{folder_of(title)}", format) for r in roots]
    tables = [conform(b, FACTS[title], title) for b in blocks]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_blocks(
    spark: SparkSession, folder: str, title: str, blocks: Sequence[str] = (), scenarios: Sequence[str] = ()
) -> DataFrame:
    """One query title of blocks written together, or of some blocks and scenarios by their files alone."""
    rows = _read_block(spark, f"{folder.rstrip('/')}/{folder_of(title)}", "parquet")
    for column, kept in (("block", blocks), ("scenario", scenarios)):
        if kept:
            rows = rows.where(F.col(column).isin(*kept))
    return conform(rows, FACTS[title], title)


def _read_block(spark: SparkSession, path: str, format: str) -> DataFrame:
    if format == "csv":
        return spark.read.option("header", True).option("nullValue", "NA").csv(path)
    # A declared type keeps codes such as 2020 or 1e5 text where they name a folder.
    columns = spark.read.format(format).load(path).schema
    named = StructType([StructField(f.name, StringType()) if f.name in ("scenario", "block") else f for f in columns])
    return spark.read.format(format).schema(named).load(path)


def read_results(spark: SparkSession, folder: str, name: str, format: str = "parquet") -> DataFrame:
    """A saved result table, with the columns that decoding the scenario has added."""
    schema, df = RESULTS[name], _read_block(spark, f"{folder.rstrip('/')}/{name}", format)
    known = conform(df, schema, name)
    decoded = [df[f"`{c}`"].cast(StringType()).alias(c) for c in df.columns if c not in schema.names]
    return df.select(*[df[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in known.schema], *decoded)
