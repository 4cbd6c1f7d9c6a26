"""Repeated runs of lines, found by winnowing over line hashes.

A run counts if it has ``min_lines`` lines or ``min_words`` words. A window is the shortest
span from a line on that reaches either; every run that counts holds a whole window, and
windows depend on their lines alone, so equal runs have equal windows. The least line hash
of each window (the rightmost of equal ones) is selected as a fingerprint: two equal runs
share at least one, at the same place in both.

1. Selected positions alone are kept, each with the digests of the lines around it, as far as
   the windows reach that it is the least line of. They are joined on their fingerprint;
   those found once end here.
2. Each position is paired with the first position of its fingerprint around which the same
   lines stand: one pair for each window that it is selected in. So a line that a third of all
   documents have makes no pairs among them.
3. Pairs of one document with one other at one distance are a match: it is extended both ways
   as long as the pairs overlap or follow on one another, and is one run of equal lines then.
4. The windows that lie in a match stand earlier as well; their lines are deleted. Windows
   that overlap or touch make one run.

Earlier means a lesser id, then (for rows that repeat an id) a lesser text digest, then a
lower line number. What remains of lines that repeat within one text is one period.

Defined cases: lines are compared without white space at either end; blank lines belong to
no run and stay; a null or empty text has no lines to delete and stays as it is; a null id
counts as the least; rows that repeat both id and text are one document, so neither is
later than the other; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import narrow, slices, written

MIN_LINES, MIN_WORDS = 3, 50
#: Bytes of a line's digest; its first eight are the line's hash.
_DIGEST = 16
_POSITION = "doc_id long, digest binary, line int, fingerprint long, around binary, windows array<struct<before: int, after: int>>"


def windows(lines: list[str], min_lines: int, min_words: int) -> list[tuple[int, int]]:
    """First and last line of the shortest span from each line on that counts as a run."""
    words = [len(line.split()) for line in lines]
    out, last, held = [], -1, 0
    for first in range(len(lines)):
        while last - first + 1 < min_lines and held < min_words:
            last += 1
            if last == len(lines):
                return out
            held += words[last]
        out.append((first, last))
        held -= words[first]
    return out


def lines_of(text: str) -> tuple[list[int], list[str]]:
    """Numbers and stripped contents of the lines that are not blank."""
    places = [(k, line) for k, raw in enumerate(text.split("\n")) if (line := raw.strip())]
    return [k for k, _ in places], [line for _, line in places]


def selected(hashes: list[int], found: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Lines that are the least of some window (the rightmost of equal ones), with those windows."""
    out: dict[int, list[tuple[int, int]]] = {}
    for first, last in found:
        out.setdefault(min(range(first, last + 1), key=lambda k: (hashes[k], -k)), []).append((first, last))
    return out


def positions(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Selected lines of every document, numbered without blank lines, and the digests of the lines around.

    ``windows``: how many lines before and after it each window has that it was selected in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32())]))
        for batch in slices(batches):
            ids, digests, at, prints, around, spans = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                digest, (_, lines) = xxhash.xxh128_digest(text), lines_of(text)
                contents = [xxhash.xxh128_digest(line) for line in lines]
                hashes = [int.from_bytes(c[:8], "little", signed=True) for c in contents]
                for k, held in selected(hashes, windows(lines, min_lines, min_words)).items():
                    ids.append(doc_id)
                    digests.append(digest)
                    at.append(k)
                    prints.append(hashes[k])
                    around.append(b"".join(contents[held[0][0] : held[-1][1] + 1]))
                    spans.append([{"before": k - a, "after": b - k} for a, b in held])
            columns = [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(at, pa.int32())]
            columns += [pa.array(prints, pa.int64()), pa.array(around, pa.binary()), pa.array(spans, window)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "line", "fingerprint", "around", "windows"])

    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, _POSITION)


def matches(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Runs of lines that stand earlier: doc_id, digest of the text, first and last line, and where they stand first.

    Lines are numbered without blank ones; ``earlier``: id, text digest and first line.
    """
    found = written(positions(docs, min_lines, min_words, id_col, text_col))
    shared = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    met = found.join(shared, "fingerprint", "left_semi")
    # the lines of a window: so many before the selected one, itself, and so many after it
    reach = F.col("windows")[0]["before"]
    each = met.select("doc_id", "digest", "line", "around", reach.alias("reach"), F.inline("windows"))
    begin, size = (F.col("reach") - F.col("before")) * _DIGEST + 1, (F.col("before") + F.col("after") + 1) * _DIGEST
    seeds = each.select(
        "doc_id", "digest", (F.col("line") - F.col("before")).alias("first"), (F.col("line") + F.col("after")).alias("last"),
        F.col("around").substr(begin, size).alias("content"),
    )
    place = F.struct("doc_id", "digest", "first")
    # a content found once has nothing to be paired with
    firsts = seeds.groupBy("content").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1")
    pairs = seeds.join(firsts.select("content", "place"), "content").where(place > F.col("place")).drop("content")
    aligned = pairs.withColumn("shift", F.col("first") - F.col("place.first")).withColumns(
        {"of": F.col("place.doc_id"), "by": F.col("place.digest")}
    )
    keys = ["doc_id", "digest", "of", "by", "shift"]
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int")
    runs = aligned.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    extended = runs.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    earlier = F.struct(F.col("of").alias("doc_id"), F.col("by").alias("digest"), (F.col("first") - F.col("shift")).alias("first"))
    return extended.select("doc_id", "digest", "first", "last", earlier.alias("earlier"))


def repeated_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, digest of the text and the spans that stand earlier, of documents with later repeats."""
    found = matches(docs, min_lines, min_words, id_col, text_col)
    return found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def inside(found: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows that lie in one of the spans; both ascend by their first line, windows by their last too."""
    out, k, reach = [], 0, -1
    spans = sorted(spans)
    for first, last in found:
        while k < len(spans) and spans[k][0] <= first:
            reach = max(reach, spans[k][1])
            k += 1
        if last <= reach:
            out.append((first, last))
    return out


def delete_repeats(
    docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_lines, deleted (first and last line of each run) and the remaining text of every document."""
    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests = [xxhash.xxh128_digest(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["doc_id", "text", "digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in slices(batches):
            counts, runs, texts = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                lines, joined, gone = text.split("\n") if text else [], [], []
                if spans:
                    places, kept = lines_of(text)
                    gone = inside(windows(kept, min_lines, min_words), [(s["first"], s["last"]) for s in spans])
                for first, last in ((places[a], places[b]) for a, b in gone):
                    if joined and first <= joined[-1]["last"] + 1:
                        joined[-1]["last"] = max(joined[-1]["last"], last)
                    else:
                        joined.append({"first": first, "last": last})
                counts.append(len(lines))
                runs.append(joined)
                numbers = {k for r in joined for k in range(r["first"], r["last"] + 1)}
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in numbers) if numbers else text)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int32()), pa.array(runs, run), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "deleted", "text"])

    spans = repeated_lines(docs, min_lines, min_words, id_col, text_col).withColumnRenamed("doc_id", "of")
    marked = rows.mapInArrow(keyed, "doc_id long, text string, digest binary")
    on = marked["doc_id"].eqNullSafe(spans["of"]) & (marked["digest"] == spans["digest"])
    joined = marked.join(spans, on, "left").select(marked["doc_id"], "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_lines int, deleted array<struct<first: int, last: int>>, text string")
