from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared(spark: SparkSession, tmp_path_factory) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark: SparkSession):
    """A table of (id, text) rows with the columns of ``documents`` and clashing further ones."""

    def make(rows, extra: bool = True):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that operators use themselves, and one that differs in case
            for name in ("kept", "fp", "shard", "rank", "spans", "length", "c0", "recognised", "sequence_id", "key", "sha", "keep", "upper"):
                df = df.withColumn(name, df["n_chars"])
            df = df.toDF(*df.columns[:-1], "TEXT")
        return df

    return make


#: Nulls in either column, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (1, "alpha beta gamma"),
    (1, "alpha beta gamma"),
    (2, "alpha beta gamma"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "alpha beta gamma"),
    (None, None),
    (6, "x" * 200_000),
    (7, "word " * 30_000),
    (8, "éü ß 日本 <|endoftext|> don't  stop\x1cnow\x01"),
    (9, "!!! 123"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
