"""Helpers shared by the operators: input columns, written tables, cached tokenization."""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time inside a task.
ROWS_AT_ONCE = 256
#: Distinct chunks that a worker's caches remember before they start anew.
CACHE_CHUNKS = 200_000
#: Distinct chunks that a tokenizer remembers (about 50 bytes each); it starts anew beyond them.
TOKEN_CHUNKS = 1_000_000
#: Distinct matches whose merges a tokenizer remembers (about 170 bytes each).
TOKEN_MATCHES = 300_000
#: Groups that a training sample is drawn from one by one; smaller ones are drawn from together.
MAX_GROUPS = 500


def position(df: DataFrame, column: str) -> int:
    """Where a column stands; of those that differ only in case, the one spelled exactly so."""
    names = list(df.columns)
    found = [i for i, n in enumerate(names) if n == column] or [
        i for i, n in enumerate(names) if n.lower() == column.lower()
    ]
    if not found:
        raise ValueError(f"no column {column} in {names}")
    return found[0]


def by_place(df: DataFrame) -> DataFrame:
    """All columns, named c0, c1, … by their places, so that no added name can clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def spelled(df: DataFrame, words: Iterable[str]) -> DataFrame:
    """All columns; of names that differ only in case, the one spelled as in ``words`` (else the first) keeps its own."""
    lower = [n.lower() for n in df.columns]
    wanted = {n.lower(): position(df, n) for n in words if n in df.columns}
    keeps = [wanted.get(n, lower.index(n)) == i for i, n in enumerate(lower)]
    return df.toDF(*[n if kept else f"_other{i}" for i, (n, kept) in enumerate(zip(df.columns, keeps))])


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator reads, under its own names.

    Further columns are dropped before any operator adds its own, so none can clash.
    """
    return by_place(df).select(*[F.col(f"c{position(df, old)}").alias(new) for new, old in columns.items()])


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Folders that this process has had tables written to, in order.
FOLDERS: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and scanned from there: its lineage ends."""
    path = shared_folder(df.sparkSession)
    FOLDERS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the tables written since there were ``since`` folders, but for the last ``keep``.

    What still reads them can no longer be computed: call it when their results are written.
    """
    end = len(FOLDERS) - keep
    for path in FOLDERS[since:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del FOLDERS[since:end]


#: Bytes of text that are encoded at a time, about.
BYTES_AT_ONCE = 4 << 20


def slices_by_size(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where the texts of column ``at`` together reach ``BYTES_AT_ONCE``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if end > begin:
                yield batch.slice(begin, end - begin)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small enough to be turned into Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def drawn(rows: DataFrame, groups: list[str], bound: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[tuple, int]]:
    """At most ``bound`` rows of each group, drawn by a hash of the id, and the groups' sizes.

    The ``MAX_GROUPS`` largest groups (labels, languages) are drawn from one by one. All
    smaller ones are one pool, drawn from like a group; its size stands under ``()``. A hash
    below a group's share lets through half as many rows again as are wanted, however large
    the group, so that no more than those meet where they are ranked.
    """
    counts = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    largest = counts.orderBy(F.col("n").desc(), *groups).limit(MAX_GROUPS + 1).collect()
    sizes = {tuple(r)[:-1]: r["n"] for r in largest[:MAX_GROUPS]}
    place = F.xxhash64(id_col) / F.lit(2.0**64) + 0.5
    below, named = F.lit(False), F.lit(False)
    for values, n in sizes.items():
        same = F.lit(True)
        for name, value in zip(groups, values):
            same = same & F.col(name).eqNullSafe(F.lit(value))
        below = below | (same & (place < min(2.0, 1.5 * bound / n)))
        named = named | same
    group = [F.col(name) for name in groups]
    if len(largest) > MAX_GROUPS:
        sizes[()] = rows.count() - sum(sizes.values())
        below = below | (~named & (place < min(2.0, 1.5 * bound / sizes[()])))
        group = [named, *[F.when(named, F.col(name)) for name in groups]]
    order = Window.partitionBy(*group).orderBy(F.xxhash64(id_col), id_col)
    ranked = rows.where(below).withColumn("_turn", F.row_number().over(order))
    return ranked.where(F.col("_turn") <= bound).drop("_turn"), sizes


def annotated(df: DataFrame, text_col: str, make: Callable[[], Callable], fields: list[tuple[str, str]]) -> DataFrame:
    """All columns of ``df`` and new ones computed from whole texts, without moving a row.

    ``make`` builds, once in each task, a function from a list of texts (null: None) to the
    arrays of the new columns. Columns keep their places, so names in ``df`` may clash in
    any way; the new ones come last.
    """
    at, plain = position(df, text_col), by_place(df)
    types = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema]
    added = [name for name, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            columns = [*batch.columns, *work(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    return plain.mapInArrow(run, ", ".join([*types, *(f"{n} {t}" for n, t in fields)]))


def restored(placed: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df`` alone, out of a table that has them by place (c0, c1, …)."""
    return placed.select(*[F.col(f"c{i}") for i in range(len(df.columns))]).toDF(*df.columns)


#: White space next to a space; Python's \s also holds the separators U+001C to U+001F.
_ADJACENT = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def space_chunks(text: str) -> list[str]:
    """``text`` cut before each single space: no match of the byte-level pattern crosses a cut.

    A cut has a visible character on either side of its space, so the space belongs to the
    match after it, whatever stands further left or right.
    """
    if not text:
        return []
    if _ADJACENT.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]


#: Characters whose class no Unicode version changes: visible Latin-1, space and line feed.
_PLAIN = re.compile("[\\n -~\xa1-\xff]*")
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Over plain characters, what the pre-tokenizers of the two kinds of files match.
_WORD_MATCHES = re.compile(f"{_ENDINGS}|[{_LETTER}]+|[{_NUMBER}]|[^\\n {_LETTER}{_NUMBER}]+")
_BYTE_MATCHES = re.compile(
    f"{_ENDINGS}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\n {_LETTER}{_NUMBER}]+|[\\n ]+(?![^\\n ])|[\\n ]+"
)


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return dict(zip(visible, visible)) | {b: 256 + k for k, b in enumerate(hidden)}


class _Store:
    """Sequences of ids end to end, found by number."""

    def __init__(self) -> None:
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        first = len(self.starts)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.starts = np.concatenate([self.starts, starts.astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        return range(first, len(self.starts))

    def laid_out(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many sequences end to end, and the length of each."""
        lengths = self.lengths[places]
        whole = np.cumsum(lengths, dtype=np.int64)
        if len(whole) and whole[-1] >= 1 << 31:  # a batch of one text of many gigabytes
            shift, steps = self.starts[places] - (whole - lengths), np.int64
        else:
            shift, steps = self.starts[places] - (whole - lengths).astype(np.int32), np.int32
        at = np.repeat(shift, lengths)
        at += np.arange(len(at), dtype=steps)
        return self.ids[at], lengths


#: What Python counts as white space, as a class for Arrow's regular expressions.
_SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_NEXT_TO_SPACE = f"{_SPACE_CLASS} | {_SPACE_CLASS}"
_NOT_PLAIN = r"[^\n\x20-~\x{a1}-\x{ff}]"


class CachedTokenizer:
    """Ids of whole texts by a tokenizers file, remembering the ids of space-separated chunks.

    Results equal those of the library on the whole text: chunks are cut where neither the
    normalizer nor the pre-tokenizer of the file looks across. Arrow cuts the texts of a batch
    and numbers their distinct chunks, and looks those up among the known; numpy lays the ids
    of all chunks end to end. New chunks of plain characters are, for the same reason, split as one
    text, and each new match is merged by the library's model; any other chunk goes through
    the library as it is. ``word_ends`` tells a file that drops white space and lower-cases
    from a byte-level one.
    """

    def __init__(self, path: str, word_ends: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.word_ends = word_ends
        self.model = self.tokenizer.model
        self.matches = (_WORD_MATCHES if word_ends else _BYTE_MATCHES).findall
        self.characters = _byte_characters()
        self.merged: dict[str, int] = {}
        self.of_matches = _Store()
        self._forget()

    def _forget(self) -> None:
        self.known = {space: pa.array([], pa.large_string()) for space in ("", " ")}  # chunks after it
        self.places = {space: np.zeros(0, np.int32) for space in ("", " ")}  # their numbers in the store
        self.of_chunks = _Store()

    def _merge(self, matches: list[str]) -> None:
        """Merge new matches by the library's model."""
        if len(self.merged) > TOKEN_MATCHES:
            self.merged, self.of_matches = {}, _Store()
        words = "\0".join(matches).encode().decode("latin-1").translate(self.characters)
        merge = self.model.tokenize
        ids = [[t.id for t in merge(w)] for w in words.split(chr(self.characters[0]))]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self.merged.update(zip(matches, self.of_matches.add(flat, lengths)))

    def _split(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks that may stand side by side, end to end, and how many each has."""
        if self.word_ends:
            chunks = [c.lower() for c in chunks]  # keeps the number of plain characters
        found = self.matches((" " if self.word_ends else "").join(chunks))
        get = self.merged.get
        numbers = list(map(get, found))
        if None in numbers:
            new = list(dict.fromkeys([m for m, k in zip(found, numbers) if k is None]))
            before = self.of_matches
            self._merge(new)
            if self.of_matches is not before:  # all were forgotten: merge what is needed again
                self._merge([m for m in dict.fromkeys(found) if m not in self.merged])
                get = self.merged.get
            numbers = list(map(get, found))
        ids, lengths = self.of_matches.laid_out(np.array(numbers, np.int64))
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), ends) + 1
        upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[last]
        return ids, np.diff(upto, prepend=0)

    def _apart(self, chunk: str) -> bool:
        """Whether a chunk between others could change their ids or its own."""
        if self.word_ends:
            return chunk == "" or "\n" in chunk or " " in chunk
        return len(chunk) < 2 or chunk[0] != " " or chunk[1] == "\n" or chunk[1] == " " or chunk[-1] == "\n" or chunk[-1] == " "

    def _learn(self, missing: list[str]) -> np.ndarray:
        """Encode new chunks; returns the number of each."""
        numbers = np.zeros(len(missing), np.int32)
        if _PLAIN.fullmatch("".join(missing)):
            apart = np.array([k for k, c in enumerate(missing) if self._apart(c)], np.int64)
        else:
            apart = np.array([k for k, c in enumerate(missing) if self._apart(c) or not _PLAIN.fullmatch(c)], np.int64)
        if len(apart):
            encoded = self.tokenizer.encode_batch_fast([missing[k] for k in apart.tolist()], add_special_tokens=False)
            ids = [np.asarray(e.ids, np.uint32) for e in encoded]
            numbers[apart] = self.of_chunks.add(np.concatenate(ids), np.array([len(i) for i in ids]))
        if len(apart) < len(missing):
            side_by_side = np.delete(np.arange(len(missing)), apart)
            chunks = [missing[k] for k in side_by_side.tolist()] if len(apart) else missing
            numbers[side_by_side] = self.of_chunks.add(*self._split(chunks))
        return numbers

    def _places(self, chunks: pa.Array, space: str = "") -> np.ndarray:
        """The number of each of distinct chunks after ``space``; unknown ones are learned."""
        known = pc.index_in(chunks, value_set=self.known[space])
        missing = known.is_null().to_numpy(zero_copy_only=False)
        places = np.zeros(len(chunks), np.int32)
        places[~missing] = self.places[space][known.drop_null().to_numpy()]
        if missing.any():
            new = chunks.filter(pa.array(missing))
            places[missing] = numbers = self._learn([space + c for c in new.to_pylist()] if space else new.to_pylist())
            self.known[space] = pa.concat_arrays([self.known[space], new])
            self.places[space] = np.concatenate([self.places[space], numbers])
        return places

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chunks of texts that Arrow can cut, and how many each text has."""
        cut = pc.ascii_split_whitespace(texts) if self.word_ends else pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        numbered = cut.flatten().dictionary_encode()
        distinct, codes = numbered.dictionary, numbered.indices.to_numpy()
        if self.word_ends:
            return self._places(distinct)[codes], np.diff(offsets)
        places = self._places(distinct, " ")[codes]
        # the first chunk of a text has no space before it
        firsts = offsets[:-1] - offsets[0]
        used, which = np.unique(codes[firsts], return_inverse=True)
        places[firsts] = self._places(distinct.take(pa.array(used)))[which]
        return places, np.diff(offsets)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins (one more than texts)."""
        pa.default_memory_pool().release_unused()
        texts = texts.cast(pa.large_string()).fill_null("")
        if len(self.of_chunks.starts) > TOKEN_CHUNKS:
            self._forget()
        if self.word_ends:
            apart = pc.match_substring_regex(texts, _NOT_PLAIN)
        else:
            apart = pc.match_substring_regex(texts, _NEXT_TO_SPACE)
        apart = apart.to_numpy(zero_copy_only=False)
        counts, here = np.zeros(len(texts), np.int64), np.flatnonzero(~apart)
        places, chunks = [], []
        if len(here):
            plain, counts[here] = self._cut(texts.take(pa.array(here)))
            places.append(plain)
        for k in np.flatnonzero(apart).tolist():
            text = texts[k].as_py()
            cut = space_chunks(text) if not self.word_ends else [text] if _SEPARATORS.search(text) else text.split()
            chunks += cut
            counts[k] = len(cut)
        if chunks:
            numbered = pa.array(chunks, pa.large_string()).dictionary_encode()
            places.append(self._places(numbered.dictionary)[numbered.indices.to_numpy()])
        # places lie by text: first those cut by Arrow, then the others
        order = np.concatenate([here, np.flatnonzero(apart)])
        at = np.concatenate([*places, np.zeros(0, np.int32)])
        ids, lengths = self.of_chunks.laid_out(at)
        text_of = np.repeat(np.arange(len(texts)), counts[order])
        sizes = np.bincount(text_of, weights=lengths, minlength=len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not apart.any():
            return ids, offsets
        begins = np.zeros(len(texts), np.int64)
        begins[order] = offsets[:-1]
        ends = np.zeros(len(texts), np.int64)
        ends[order] = offsets[1:]
        whole = [ids[b:e] for b, e in zip(begins.tolist(), ends.tolist())]
        return np.concatenate([*whole, ids[:0]]), np.concatenate([[0], np.cumsum(ends - begins)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, offsets = self.encode_array(pa.array(texts, pa.large_string()))
        data, at = ids.astype("<u4", copy=False).tobytes(), (4 * offsets).tolist()
        return [data[b:e] for b, e in zip(at, at[1:])]


@functools.lru_cache(maxsize=2)
def cached_tokenizer(path: str, word_ends: bool) -> CachedTokenizer:
    """The tokenizer of a file, kept by a Python worker from one task to the next."""
    return CachedTokenizer(path, word_ends)


def little_u4(number: int) -> bytes:
    return struct.pack("<I", number)
