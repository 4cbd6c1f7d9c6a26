"""A project: tables by title, delivered in blocks of scenarios under one manifest.

    <root>/<title>/delivery=<id>/scenario=<name>/part-….parquet
    <root>/_manifests/<id>/part-….parquet       title, scenario, block, delivery, fingerprint
    <root>/_commits/<number>.json               names the manifest that holds from then on

Every delivery writes folders of its own and is seen once its manifest is committed, all
titles and scenarios at a time. What a delivery replaces stays on disk, unseen, until
``vacuum``. Overwriting partitions in place would show a reader, or leave behind a failure,
a mixture of old and new scenarios; here a failed delivery changes nothing.

A title has each scenario once: a scenario that another block has brought is refused, or
passes to the new block (``conflict``). A block delivered again replaces the scenarios that
it brings and keeps its others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wellspring.sources.sinks import save_parquet
from wellspring.sources.tables import folder_of
from wellspring.sources.workspace import materialize

MANIFEST = "title string, scenario string, block string, delivery string, fingerprint string"
COMMITS, MANIFESTS = "_commits", "_manifests"


class ScenarioConflict(ValueError):
    """A scenario is delivered by two blocks."""


@dataclass(frozen=True)
class Project:
    """The project in the folder ``root`` of any file system that Spark writes to."""

    root: str

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    # Commits

    def commits(self, spark: SparkSession) -> list[int]:
        fs, folder = _file_system(spark, self.path(COMMITS))
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _current(self, spark: SparkSession) -> tuple[int, str | None]:
        numbers = self.commits(spark)
        if not numbers:
            return 0, None
        text = spark.read.text(self.path(COMMITS, f"{numbers[-1]}.json")).first()[0]
        return numbers[-1], json.loads(text)["manifest"]

    def manifest(self, spark: SparkSession) -> DataFrame:
        """Which delivery holds each title and scenario now; empty before the first commit."""
        return self._manifest(spark, self._current(spark)[1])

    def _manifest(self, spark: SparkSession, name: str | None) -> DataFrame:
        if name is None:
            return spark.createDataFrame([], MANIFEST)
        return spark.read.schema(MANIFEST).parquet(self.path(MANIFESTS, name))

    def _commit(self, spark: SparkSession, after: int, manifest: DataFrame) -> None:
        """Make ``manifest`` the one that holds, unless another commit has come in between."""
        name = uuid.uuid4().hex
        manifest.select(*[f.split()[0] for f in MANIFEST.split(", ")]).write.parquet(self.path(MANIFESTS, name))
        number = after + 1
        fs, target = _file_system(spark, self.path(COMMITS, f"{number}.json"))
        staged = _file_system(spark, self.path(COMMITS, f".{name}"))[1]
        out = fs.create(staged, False)
        out.write(json.dumps({"manifest": name}).encode())
        out.close()
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise RuntimeError(f"{self.root}: commit {number} was made by someone else; deliver again")

    # Deliveries

    def deliver(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame],
        block: str,
        conflict: str = "error",
        fingerprints: DataFrame | None = None,
        without: DataFrame | None = None,
    ) -> None:
        """Write tables by title and commit them together.

        ``fingerprints`` (scenario, fingerprint) is kept in the manifest. ``without`` lists
        scenarios that leave the project in the same commit.
        """
        if conflict not in ("error", "replace"):
            raise ValueError(f"conflict: {conflict!r} is neither error nor replace")
        number, name = self._current(spark)
        held = self._manifest(spark, name)
        delivery = uuid.uuid4().hex
        brought = []
        for title, df in tables.items():
            path = self.path(folder_of(title), f"delivery={delivery}")
            save_parquet(df, path)
            names = spark.read.schema("scenario string").parquet(path).distinct()  # of the folders' names
            brought.append(names.select(F.lit(title).alias("title"), "scenario"))
        new = materialize(reduce(DataFrame.unionByName, brought), "brought")
        if not new.where(F.col("scenario").isNull()).isEmpty():
            raise ValueError("a row names no scenario")
        keys = ["title", "scenario"]
        if conflict == "error":
            taken = held.where(F.col("block") != block).join(new, keys, "left_semi")
            found = taken.select(*keys, "block").limit(5).collect()
            if found:
                raise ScenarioConflict("; ".join(f"{r.scenario} of {r.title} is in block {r.block}" for r in found))
        rows = new.select(*keys, F.lit(block).alias("block"), F.lit(delivery).alias("delivery"))
        if fingerprints is None:
            rows = rows.withColumn("fingerprint", F.lit(None).cast("string"))
        else:
            rows = rows.join(fingerprints.select("scenario", "fingerprint"), "scenario", "left")
        kept = held.join(new, keys, "left_anti")
        if without is not None:
            kept = kept.join(without.select("scenario"), "scenario", "left_anti")
        self._commit(spark, number, kept.unionByName(rows))

    def withdraw(self, spark: SparkSession, scenarios: DataFrame) -> None:
        """Commit a manifest without some scenarios."""
        number, name = self._current(spark)
        held = self._manifest(spark, name)
        self._commit(spark, number, held.join(scenarios.select("scenario"), "scenario", "left_anti"))

    def read(self, spark: SparkSession, title: str) -> DataFrame:
        """A title over all scenarios of the committed manifest, each once.

        Deliveries that hold nothing any more are pruned as partitions; within the others
        the manifest picks scenarios. Conditions on ``scenario`` prune partitions too.
        """
        held = self.manifest(spark).where(F.col("title") == title).select("delivery", "scenario")
        deliveries = [r[0] for r in held.select("delivery").distinct().collect()]  # one for each delivery
        if not deliveries:
            raise ValueError(f"{self.root}: no scenario of {title!r} has been delivered")
        rows = _read(spark, self.path(folder_of(title)), ("delivery", "scenario"))
        seen = rows.where(F.col("delivery").isin(*deliveries)).join(held, ["delivery", "scenario"], "left_semi")
        return seen.drop("delivery")

    def vacuum(self, spark: SparkSession, titles: Mapping[str, object] | list[str]) -> int:
        """Remove deliveries that the committed manifest does not name; returns how many."""
        held = self.manifest(spark)
        removed = 0
        for title in titles:
            live = {r[0] for r in held.where(F.col("title") == title).select("delivery").distinct().collect()}
            fs, folder = _file_system(spark, self.path(folder_of(title)))
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                name = status.getPath().getName()
                if name.startswith("delivery=") and name.removeprefix("delivery=") not in live:
                    fs.delete(status.getPath(), True)
                    removed += 1
        return removed


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str, strings: tuple[str, ...]) -> DataFrame:
    """A partitioned table whose partition columns are text, whatever they look like."""
    columns = spark.read.parquet(path).schema
    named = [StructField(f.name, StringType()) if f.name in strings else f for f in columns]
    return spark.read.schema(StructType(named)).parquet(path)
