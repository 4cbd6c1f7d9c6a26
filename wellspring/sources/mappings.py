"""Mapping tables: small, hand-written configuration that is joined onto facts.

They are held as rows on the driver, with their size checked when they are read, so
broadcasting them and building literals from them is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring import fixed_values as fv
from wellspring.sources.schemas import MAPPINGS, conform

MAX_MAPPING_ROWS = 10_000

_ARROW = {"string": pa.string(), "double": pa.float64()}


@dataclass(frozen=True)
class Mappings:
    """The five mapping tables as tuples of rows."""

    fuel_techs: tuple[tuple, ...]
    co2_ef: tuple[tuple, ...]
    nonco2_gwp: tuple[tuple, ...]
    fuel_delivery_cost: tuple[tuple, ...]
    scenario_definitions: tuple[tuple, ...]

    def __post_init__(self):
        for name in MAPPINGS:
            if len(getattr(self, name)) > MAX_MAPPING_ROWS:
                raise ValueError(f"{name}: a mapping table has at most {MAX_MAPPING_ROWS} rows")
        fuels = self.column("fuel_techs", "fuel")
        if len(set(fuels)) != len(fuels):
            raise ValueError("fuel_techs: each fuel must be listed once")

    @classmethod
    def published(cls) -> Mappings:
        return cls(fv.FUEL_TECHS, fv.CO2_FACTORS, fv.GWP, fv.DELIVERY_COST, fv.SCENARIO_DEFINITIONS)

    @classmethod
    def read_csv(cls, spark: SparkSession, folder: str) -> Mappings:
        """Read ``<folder>/<mapping>.csv`` files with a header line."""
        return cls(**{name: _read_rows(spark, folder, name) for name in MAPPINGS})

    def column(self, table: str, name: str) -> list:
        i = MAPPINGS[table].names.index(name)
        return [row[i] for row in getattr(self, table)]

    def records(self, table: str) -> list[dict]:
        return [dict(zip(MAPPINGS[table].names, row)) for row in getattr(self, table)]

    def frame(self, spark: SparkSession, table: str, *columns: str) -> DataFrame:
        """Distinct rows of a mapping table, or of some of its columns, for broadcast."""
        names = list(columns or MAPPINGS[table].names)
        rows = list(dict.fromkeys(zip(*[self.column(table, n) for n in names])))
        types = [_ARROW[MAPPINGS[table][n].dataType.simpleString()] for n in names]
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return F.broadcast(spark.createDataFrame(pa.table(arrays, names=names)))

    @property
    def primary_commodities(self) -> list[str]:
        return self.column("co2_ef", "sector")


def _read_rows(spark: SparkSession, folder: str, name: str) -> tuple[tuple, ...]:
    raw = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")
    raw = raw.select(*[F.nullif(F.col(f"`{c}`"), F.lit("NA")).alias(c) for c in raw.columns])
    rows = conform(raw, MAPPINGS[name], name).limit(MAX_MAPPING_ROWS + 1).collect()
    return tuple(tuple(r) for r in rows)
