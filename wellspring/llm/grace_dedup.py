"""Exact duplicate removal by grace hashing.

1. Each task folds the copies it holds into one record for each text (content, greatest id,
   number of rows), so a text that a third of all rows share leaves a task once.
2. The records are dealt by a hash of the content. A task fills an open-addressing table
   that compares complete content; once the table is full, records of texts it does not
   hold go to spill files by further bits of the hash, and each file is worked off the same
   way, one level deeper. Copies of a text in the table take no room, so any number of
   copies is no burden, and each level holds fewer texts than the one before.
3. Rows learn their group by the sha256 of their text; that join carries no text, and
   adaptive execution splits a hot text's rows.

Spill files are a task's own scratch, removed before it ends; nothing else reads them, and
a lost task starts again from its shuffled input.

Defined cases: a null text is empty; the row with the greatest id stays, null being the
least; rows that repeat id and text count in ``group_size`` and give one result row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import by_place, narrow, position, restored, slices

#: Content that a task's table holds before records of other texts are set aside.
TABLE_BYTES = 48 << 20
#: Files that a full table sets records aside into; a power of two.
FANOUT = 16
Record = tuple[int, bytes, int | None, int]  # hash, content, greatest id, rows
_RECORD = "hash long, content binary, greatest long, rows long"


def _greater(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class ContentTable:
    """Open addressing with linear probing; slots hold entries that are compared in full."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.greatest: list[int | None] = []
        self.rows: list[int] = []

    def _slot(self, key: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = key & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, record: Record) -> bool:
        """Fold the record in; False if its text is new and the table is full."""
        key, content, greatest, rows = record
        at = self._slot(key, content)
        if (entry := self.slots[at]) >= 0:
            self.greatest[entry] = _greater(self.greatest[entry], greatest)
            self.rows[entry] += rows
            return True
        if self.held >= self.limit:
            return False
        self.slots[at] = len(self.hashes)
        self.hashes.append(key)
        self.contents.append(content)
        self.greatest.append(greatest)
        self.rows.append(rows)
        self.held += len(content) + 200  # what an entry takes besides its content
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for entry, key in enumerate(self.hashes):
                at = key & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = entry
        return True

    def records(self) -> Iterator[Record]:
        return zip(self.hashes, self.contents, self.greatest, self.rows)


def _stored(record: Record) -> bytes:
    key, content, greatest, rows = record
    head = key.to_bytes(8, "little") + (greatest is None).to_bytes(1, "little")
    head += (greatest or 0).to_bytes(8, "little", signed=True) + rows.to_bytes(8, "little")
    return head + len(content).to_bytes(8, "little") + content


def _restored(path: str) -> Iterator[Record]:
    with open(path, "rb") as file:
        while head := file.read(33):
            number = lambda a, b, signed=False: int.from_bytes(head[a:b], "little", signed=signed)
            content = file.read(number(25, 33))
            yield number(0, 8), content, None if head[8] else number(9, 17, True), number(17, 25)


def grace_groups(
    records: Iterable[Record], folder: str, limit: int = TABLE_BYTES, depth: int = 0, name: str = "b"
) -> Iterator[Record]:
    """One record for each distinct content, by recursive partitioning into spill files.

    The hash has 64 bits; below the last level of bits, files are split by rereading them
    against a fresh table, which still takes in ``limit`` bytes of texts at each pass.
    """
    table, files = ContentTable(limit), {}
    for record in records:
        if not table.add(record):
            part = (record[0] >> (60 - 4 * depth)) % FANOUT if depth < 15 else 0
            if part not in files:
                files[part] = open(f"{folder}/{name}-{part}", "wb")  # noqa: SIM115
            files[part].write(_stored(record))
    for file in files.values():
        file.close()
    yield from table.records()
    del table
    for part in sorted(files):
        path = f"{folder}/{name}-{part}"
        yield from grace_groups(_restored(path), folder, limit, depth + 1, f"{name}-{part}")
        os.unlink(path)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for batch in slices(batches):
        for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield xxhash.xxh64_intdigest(content), content, doc_id, 1


def _sent(records: Iterable[Record]) -> Iterator[pa.RecordBatch]:
    names = ["hash", "content", "greatest", "rows"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for key, content, greatest, rows in records:
        held.append((key - (1 << 64) if key >> 63 else key, content, greatest, rows))
        size += len(content)
        if size > 4 << 20 or len(held) >= 4096:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """text_sha256, keep_id and group_size of every distinct text."""
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content")
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a full table is sent on and started anew: folding is only to make hot texts few
        def folded() -> Iterator[Record]:
            table = ContentTable(table_bytes // 2)
            for record in _read(batches):
                if not table.add(record):
                    yield from table.records()
                    table = ContentTable(table_bytes // 2)
                    table.add(record)
            yield from table.records()

        return _sent(folded())

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in slices(batches):
                for key, content, greatest, n in zip(*(c.to_pylist() for c in batch.columns)):
                    yield key % (1 << 64), content, greatest, n

        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            held: list[tuple] = []
            for _, content, greatest, n in grace_groups(records(), folder, table_bytes):
                held.append((hashlib.sha256(content).hexdigest(), greatest, n))
                if len(held) >= 8192:
                    yield _grouped(held)
                    held = []
            if held:
                yield _grouped(held)

    return (
        rows.mapInArrow(fold, _RECORD)
        .repartition("hash")
        .mapInArrow(group, "text_sha256 string, keep_id long, group_size long")
    )


def _grouped(held: list[tuple]) -> pa.RecordBatch:
    sha, greatest, n = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(sha, pa.string()), pa.array(greatest, pa.int64()), pa.array(n, pa.int64())],
        ["text_sha256", "keep_id", "group_size"],
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, dropped ones too."""
    members = (
        narrow(docs, doc_id=id_col, text=text_col)
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
        )
        .distinct()
    )
    return members.join(groups(docs, id_col, text_col, table_bytes), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without later copies, all their columns; repeated rows stay once."""
    # one key column for known and null ids, so that the join's partitioning serves the rest
    def key(doc_id: Column) -> Column:
        return F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")).alias("key")

    kept = exact_groups(docs, id_col, text_col).where("kept").select(key(F.col("doc_id")), F.col("text_sha256").alias("sha"))
    text = F.coalesce(F.col(f"c{position(docs, text_col)}"), F.lit("")).cast("binary")
    marked = by_place(docs).select("*", key(F.col(f"c{position(docs, id_col)}")), F.sha2(text, 256).alias("sha"))
    return restored(marked.join(kept, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]), docs)
