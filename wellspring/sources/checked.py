"""Reading headed CSV blocks whose rows may not parse: what parses, and the rest set aside."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wellspring.sources.schemas import FACTS, OPTIONAL, require_columns
from wellspring.sources.tables import folder_of

_LINE = "_unparsed_line"


@dataclass(frozen=True)
class Checked:
    """``good`` has the columns of the title; ``quarantine`` title, file, reason and record.

    ``reason`` names the first column that does not parse, or is "line" where a line has more
    or fewer fields than the header. ``record`` is the line, or the row's fields as JSON.
    """

    good: DataFrame
    quarantine: DataFrame

    def counts(self) -> DataFrame:
        """Rows set aside by title, file and reason."""
        return self.quarantine.groupBy("title", "file", "reason").agg(F.count(F.lit(1)).alias("rows"))


def read_checked(spark: SparkSession, roots: Sequence[str], title: str, null_value: str = "NA") -> Checked:
    """One title over all blocks in one pass each; nothing is dropped and nothing fails.

    Fields are read as text and cast row by row, so a bad number costs its row alone.
    """
    parts = [_read(spark, f"{r.rstrip('/')}/{folder_of(title)}", title, null_value) for r in roots]
    good = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g for g, _ in parts])
    return Checked(good, reduce(DataFrame.unionByName, [q for _, q in parts]))


def _read(spark: SparkSession, path: str, title: str, null_value: str) -> tuple[DataFrame, DataFrame]:
    header = spark.read.option("header", True).csv(path)
    schema = FACTS[title]
    require_columns(header, schema.names, title)
    text = StructType([StructField(n, StringType()) for n in [*header.columns, _LINE]])
    options = {"header": True, "nullValue": null_value, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE}
    rows = spark.read.options(**options).schema(text).csv(path)
    cast = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}
    fails = [F.when(F.col(f"`{n}`").isNotNull() & c.isNull(), F.lit(n)) for n, c in cast.items()]
    reason: Column = F.coalesce(F.when(F.col(_LINE).isNotNull(), F.lit("line")), *fails)
    marked = rows.withColumn("_reason", reason).withColumn("_file", F.input_file_name())
    further = [n for n in OPTIONAL.get(title, ()) if n in header.columns]
    good = marked.where(F.col("_reason").isNull()).select(
        *[c.alias(n) for n, c in cast.items()], *[F.col(f"`{n}`") for n in further]
    )
    fields = F.to_json(F.struct(*[F.col(f"`{n}`") for n in header.columns]))
    bad = marked.where(F.col("_reason").isNotNull()).select(
        F.lit(title).alias("title"), F.col("_file").alias("file"), F.col("_reason").alias("reason"),
        F.coalesce(F.col(_LINE), fields).alias("record"),
    )
    return good, bad
