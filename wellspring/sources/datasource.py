"""``spark.read.format("lca_project")``: a title of a project, pruned by block and scenario.

    register(spark)
    read = spark.read.format("lca_project").option("title", "outputs by tech")
    read.option("scenario", "h1r1b1n1c1p1").load(root)

The committed manifest of a project (``sources/project.py``) says which files hold a title.
The options ``scenario``, ``block`` (a name, or a JSON list of names) and ``like`` (a pattern
found in the scenario) are applied to it, so no file of another scenario is listed, planned
or opened. Files become Arrow batches in the executors; a task reads about ``TASK_BYTES`` of
one scenario. ``Project.read`` scans the same files with Spark's own Parquet reader, which
also prunes columns; this source is for picking few scenarios out of many, where listing and
planning all their folders costs more than the scan.

Options rather than pushed filters: Spark 4.1 keeps a Python source's pushed filters with the
loaded table, and a later query on the same DataFrame without a filter then lacks rows (seen
with 4.1.2). Conditions in a query are Spark's to evaluate here, and always hold.

File systems are those of pyarrow: local paths, s3 (s3a is read as s3), gs, hdfs with libhdfs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

import wellspring
from wellspring.sources.project import COMMITS, MANIFESTS
from wellspring.sources.schemas import FACTS, RESULTS
from wellspring.sources.tables import folder_of

#: Bytes of files that one task reads, about.
TASK_BYTES = 128 << 20
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


class ProjectSource(DataSource):
    """Options: ``path`` (the project's root), ``title``, ``scenario``, ``block``, ``like``."""

    @classmethod
    def name(cls) -> str:
        return "lca_project"

    def schema(self) -> StructType:
        title = self.options.get("title")
        known = {**FACTS, **RESULTS}
        if title not in known:
            raise ValueError(f"title {title!r} is none of {', '.join(known)}")
        return StructType([*known[title], StructField("block", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ProjectReader(self.options["path"], self.options["title"], schema, **{
            name: self.options[name] for name in ("scenario", "block", "like") if name in self.options
        })


@dataclass
class Files(InputPartition):
    """Files of one scenario that one task reads."""

    scenario: str
    block: str
    paths: tuple[str, ...]

    def __init__(self, scenario: str, block: str, paths: tuple[str, ...]):
        self.scenario, self.block, self.paths = scenario, block, paths


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    scheme, found, rest = path.partition("://")
    if not found:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def listed(at: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return at.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def names(option: str | None) -> frozenset[str] | None:
    """The names that an option lists; None if it is not given."""
    if option is None:
        return None
    return frozenset(json.loads(option) if option.startswith("[") else [option])


class ProjectReader(DataSourceReader):
    def __init__(
        self, root: str, title: str, schema: StructType,
        scenario: str | None = None, block: str | None = None, like: str | None = None,
    ):
        self.root, self.title = root.rstrip("/"), title
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema]
        self.scenarios, self.blocks, self.like = names(scenario), names(block), like

    def wanted(self, row: dict[str, str]) -> bool:
        return (
            row["title"] == self.title
            and (self.scenarios is None or row["scenario"] in self.scenarios)
            and (self.blocks is None or row["block"] in self.blocks)
            and (self.like is None or re.search(self.like, row["scenario"]) is not None)
        )

    def manifest(self) -> list[dict[str, str]]:
        at, root = file_system(self.root)
        commits = [f.base_name for f in listed(at, f"{root}/{COMMITS}") if f.base_name.endswith(".json") and f.base_name[0] != "."]
        if not commits:
            return []
        newest = max(commits, key=lambda n: int(n.removesuffix(".json")))
        with at.open_input_stream(f"{root}/{COMMITS}/{newest}") as commit:
            name = json.loads(commit.read())["manifest"]
        rows: list[dict[str, str]] = []
        for info in listed(at, f"{root}/{MANIFESTS}/{name}"):
            if info.base_name.endswith(".parquet"):
                with at.open_input_file(info.path) as file:
                    rows += pq.read_table(file, columns=["title", "scenario", "block", "delivery"]).to_pylist()
        return [r for r in rows if self.wanted(r)]

    def partitions(self) -> list[InputPartition]:
        at, root = file_system(self.root)
        wanted = self.manifest()
        parts: list[InputPartition] = []
        for delivery in sorted({r["delivery"] for r in wanted}):
            folders = listed(at, f"{root}/{folder_of(self.title)}/delivery={delivery}")
            by_name = {unquote(f.base_name.removeprefix("scenario=")): f.path for f in folders}
            for row in sorted((r for r in wanted if r["delivery"] == delivery), key=lambda r: r["scenario"]):
                parts += self._tasks(row, listed(at, by_name[row["scenario"]]))
        return parts

    def _tasks(self, row: dict[str, str], infos: list[fs.FileInfo]) -> Iterator[Files]:
        paths, size = [], 0
        for info in sorted(infos, key=lambda i: i.path):
            if info.base_name.endswith(".parquet"):
                if paths and size + info.size > TASK_BYTES:
                    yield Files(row["scenario"], row["block"], tuple(paths))
                    paths, size = [], 0
                paths.append(info.path)
                size += info.size
        if paths:
            yield Files(row["scenario"], row["block"], tuple(paths))

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        at, _ = file_system(self.root)
        constant = {"scenario": partition.scenario, "block": partition.block}
        schema = pa.schema([(n, _ARROW[t]) for n, t in self.columns])
        for path in partition.paths:
            with at.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches():
                    arrays = [
                        pa.array([constant[f.name]] * batch.num_rows, pa.string())
                        if f.name in constant
                        else pc.cast(batch.column(f.name), f.type)
                        for f in schema
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session.

    The source travels by value: the process that plans it does not import this package.
    """
    cloudpickle.register_pickle_by_value(wellspring)
    try:
        spark.dataSource.register(ProjectSource)
    finally:
        cloudpickle.unregister_pickle_by_value(wellspring)
