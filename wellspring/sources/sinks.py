"""Writing fact and result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.sources.tables import folder_of

MAX_RECORDS_PER_FILE = 20_000_000


def save_parquet(df: DataFrame, path: str, by: str | None = "scenario") -> None:
    """Write Parquet with one folder per scenario.

    The rebalance hint gathers a scenario's rows into few files and lets adaptive
    execution split a scenario that is far larger than the others.
    """
    writer = df if by is None else df.hint("rebalance", by)
    out = writer.write.mode("errorifexists").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    (out if by is None else out.partitionBy(by)).parquet(path)


def save_fact(df: DataFrame, root: str, title: str) -> None:
    save_parquet(df, f"{root.rstrip('/')}/{folder_of(title)}")


def save_scenarios_like(df: DataFrame, pattern: str, root: str, title: str) -> None:
    """Keep the scenarios whose name matches and save them as a block of their own."""
    save_fact(df.where(F.col("scenario").rlike(pattern)), root, title)


def save_blocks(df: DataFrame, blocks: Mapping[str, str], folder: str, title: str) -> None:
    """Write several blocks of scenarios in one pass over the rows, as <title>/block=…/scenario=….

    ``blocks`` gives each block's name the pattern of its scenarios. A scenario that matches
    no pattern is left out; one that matches two would be doubled, and fails the job.
    """
    scenario = F.col("scenario")
    hits = F.filter(
        F.array(*[F.when(scenario.rlike(pattern), F.lit(block)) for block, pattern in blocks.items()]), lambda b: b.isNotNull()
    )
    twice = F.raise_error(F.concat(F.lit("scenario "), scenario, F.lit(" is in blocks "), F.array_join(hits, ", ")))
    placed = df.withColumn("block", F.when(F.size(hits) > 1, twice).otherwise(F.get(hits, F.lit(0))).cast("string"))
    out = placed.where(F.col("block").isNotNull()).hint("rebalance", "block", "scenario").write
    out = out.mode("errorifexists").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    out.partitionBy("block", "scenario").parquet(f"{folder.rstrip('/')}/{folder_of(title)}")


def save_csv(df: DataFrame, path: str) -> None:
    """Write headed CSV files with NA for missing values and NaN kept apart."""
    (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("nullValue", "NA")
        .option("nanValue", "NaN")
        .csv(path)
    )
