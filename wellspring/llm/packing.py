"""Packing documents into sequences of fixed length by minimum bin slack.

Documents are encoded once; each is cut into full sequences and one rest. The multiset of
piece lengths has at most ``capacity`` different values however many documents there are, so
it is planned in the driver: each window takes the greatest remaining length and, by subset
sums held as bits of an integer, the multiset of remaining lengths that comes closest to the
capacity; walking the sums back gives the count of each length. A window is used again as
often as the remaining counts allow. Pieces then find their window from their number among
the pieces of their length; those numbers are counted in buckets of a hash, so that a length
shared by a third of all pieces is no task of its own.

Defined cases: a null text is empty; an empty document is its end id alone; rows that repeat
an id are packed each; a null id is packed like any other; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import cached_tokenizer, narrow, slices_by_size, written

#: Pieces that share a bucket of a length's numbering, about.
BUCKET_ROWS = 250_000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, word_ends: bool = False,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Full sequences and the rest of every document; ``with_ids`` adds the ids of each piece."""
    schema = _PIECE + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = cached_tokenizer(tokenizer_path, word_ends)
        for batch in slices_by_size(batches, 1):
            ids, offsets = tokens.encode_array(batch.column(1))
            ends = offsets[1:]
            ids = np.insert(ids, ends, end_id)  # after each document
            sizes = np.diff(offsets) + 1
            begins = np.cumsum(sizes) - sizes
            count = -(-sizes // capacity)  # pieces of each document
            of = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(sizes[of] - start, capacity)
            at = begins[of] + start
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * b : 4 * e]) for b, e in zip(at.tolist(), (at + length).tolist())]
            columns = [
                batch.column(0).take(pa.array(of)),
                *(pa.array(c, pa.int64()) for c in (start, length, crc, sizes[of])),
            ]
            if with_ids:
                bounds = pa.array(np.append(at, len(ids)), pa.int32())
                columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 if with_ids else 5]

    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset within ``counts`` whose sum comes closest to ``room`` from below."""
    sums, steps, all_sums = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        steps.append((length, sums))
        left, share = min(counts[length], room // length), 1
        while left > 0:  # powers of two and a rest reach every number up to the count
            take = min(share, left)
            sums |= (sums << (take * length)) & all_sums
            left, share = left - take, 2 * share
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, before in reversed(steps):
        uses = 0
        while not before >> at & 1:
            at, uses = at - length, uses + 1
        if uses:
            chosen[length] = uses
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows (uses of each length) and how often each is used, until no length is left."""
    left, windows = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        greatest = max(left)
        rest = dict(left)
        rest[greatest] -= 1
        window = fullest(rest, capacity - greatest)
        window[greatest] = window.get(greatest, 0) + 1
        times = min(left[n] // uses for n, uses in window.items())
        windows.append((window, times))
        for n, uses in window.items():
            left[n] -= uses * times
            if not left[n]:
                del left[n]
    return windows


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut`` (as by ``pieces``) with sequence_id and offset; ids of sequences have no gaps."""
    number = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    buckets = max(1, -(-cut.count() // BUCKET_ROWS))
    marked = cut.withColumn("bucket", F.pmod(number, F.lit(buckets)))
    sizes = marked.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # one row for each length: at most ``capacity`` of them
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    spans = []  # length, number of its first piece here, uses a window, first sequence, offset
    numbered, sequence = dict.fromkeys(counts, 0), 0
    for window, times in plan(counts, capacity):
        offset = 0
        for length in sorted(window, reverse=True):
            spans.append((length, numbered[length], window[length], sequence, offset))
            numbered[length] += window[length] * times
            offset += length * window[length]
        sequence += times
    table = np.array(sorted(spans), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 44 | table[:, 1]

    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ordered = marked.withColumn("rank", F.row_number().over(order)).join(starts, ["length", "bucket"])
    ready = ordered.withColumn("number", F.col("before") + F.col("rank") - 1).select(*cut.columns, "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column("number").to_numpy(zero_copy_only=False).astype(np.int64)
            span = table[np.searchsorted(keys, length << 44 | number, "right") - 1]
            turn, use = np.divmod(number - span[:, 1], span[:, 2])
            columns = [batch.column(n) for n in cut_names]
            placed = [pa.array(span[:, 3] + turn), pa.array(span[:, 4] + use * length)]
            yield pa.RecordBatch.from_arrays(columns + placed, [*cut_names, "sequence_id", "offset"])

    cut_names = cut.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema]
    return ready.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, word_ends: bool = False,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every piece of every document with the sequence it lies in and where."""
    return pack(written(pieces(docs, tokenizer_path, end_id, capacity, word_ends, with_ids, id_col, text_col)), capacity)


def sequences(packed: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """sequence_id, padded ids and the number of real ids, from pieces packed ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    whole = packed.groupBy("sequence_id").agg(ids.alias("ids"))
    padding = F.array_repeat(F.lit(pad_id).cast("long"), (F.lit(capacity) - F.size("ids")).cast("int"))
    return whole.select("sequence_id", F.concat("ids", padding).alias("ids"), F.size("ids").alias("n_ids"))
