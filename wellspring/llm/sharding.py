"""Uniform random shards of exact size by a hypergeometric communication matrix.

Documents lie in source partitions (by a hash of the row). How many rows of each partition
go to each shard is drawn exactly, as if all rows were shuffled: rows of the matrix sum to
partition sizes, columns to shard sizes. Each partition permutes its rows and deals them by
its row of the matrix; each shard permutes what it gets. Every permutation of all rows is
then equally likely, and shard sizes differ by one at most, with one exchange for each of the two
permutations and no row counted through the driver: it sees the sizes of the partitions.

Permutations sort by a seeded hash of the row, so a task that runs again deals the same way.
Within a shard, ranges of that hash are numbered apart and put one after another.

Defined cases: a null text has no bytes (size 1, crc32 0) like an empty one; rows that
repeat are dealt each; a null id is dealt like any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import narrow, written

#: Rows of a source partition, and of a range within a shard, about.
PARTITION_ROWS = 250_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` of good + bad, for populations of any size.

    Inverts the distribution over 40 standard deviations around its mean; what lies beyond
    has less weight than a double can tell.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mean = drawn * good / total
    spread = np.sqrt(mean * (bad / total) * max(total - drawn, 1) / max(total - 1, 1))
    low, high = max(low, int(mean - 20 * spread) - 40), min(high, int(mean + 20 * spread) + 40)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(ratio)))
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def communication_matrix(partitions: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts by partition and shard, distributed as a uniform shuffle makes them."""
    rng = np.random.default_rng(seed)
    room = list(shards)
    matrix = np.zeros((len(partitions), len(shards)), np.int64)
    for i, rows in enumerate(partitions):
        rest_rows, rest_room = rows, sum(room)
        for j in range(len(shards)):
            rest_room -= room[j]
            matrix[i, j] = hypergeometric(rng, room[j], rest_room, rest_rows)
            rest_rows -= int(matrix[i, j])
        for j in range(len(shards)):
            room[j] -= int(matrix[i, j])
    return matrix


def deal(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = written(rows)

    def key(salt: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), "doc_id", "size", "text_crc32")

    total = rows.count()
    parts = max(1, -(-total // PARTITION_ROWS))
    marked = rows.select("*", F.pmod(key(0), F.lit(parts)).alias("part"), key(1).alias("first"), key(2).alias("second"))
    # one row for each partition of PARTITION_ROWS rows
    sizes = sorted((r.part, r.n) for r in marked.groupBy("part").agg(F.count("*").alias("n")).collect())
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([n for _, n in sizes], quotas, seed).cumsum(axis=1)
    ends = spark.createDataFrame(
        [(part, row.tolist()) for (part, _), row in zip(sizes, matrix)], "part long, ends array<long>"
    )

    tie = ["doc_id", "size", "text_crc32"]
    place = F.row_number().over(Window.partitionBy("part").orderBy("first", *tie)) - 1
    dealt = marked.withColumn("place", place).join(ends, "part").select(
        *tie, "second", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard")
    )
    # ranges of the second key, in order: floor over the key's whole span
    span = F.floor((F.col("second") / F.lit(2.0**64) + 0.5) * F.lit(max(1, -(-total // (shards * PARTITION_ROWS)))))
    ranged = written(dealt.withColumn("span", span))
    counts = ranged.groupBy("shard", "span").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "span", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "span").orderBy("second", *tie))
    return ranged.withColumn("rank", rank).join(starts, ["shard", "span"]).select(
        *tie, F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
