"""Token ids in binary files: a shared zstandard dictionary, one frame for each document.

A shard file holds, in ascending document order, one zstandard frame for each document.
All frames use one dictionary trained on serialized id arrays, so that short documents
compress well and each can be read alone. Layout of a file, all numbers little-endian:

    magic "WTID", format version u4, bytes of an id u4 (2 or 4), sha256 of the dictionary (32)
    frames, one after another
    index: for each document INDEX (id, whether the id is null, offset and size of its frame, ids)
    footer: offset of the index u8, documents u8, ids u8, crc32 of the index u4, magic

The dictionary is the file ``dictionary`` in the same folder. Shards are written under a
name of their own for each attempt of a task; the manifest table, committed by Spark, names
the files that count, so a lost executor or a second attempt leaves no wrong file behind.

Defined cases: a null text is empty; an empty document has the end id alone; documents with
a null id come first; rows that repeat an id are kept, in the order of their texts; an
empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspring.llm.common import cached_tokenizer, crc32_of, little_u4, narrow, shared_folder, slices_by_size

MAGIC = b"WTID"
HEADER, HEADER_BYTES = "<4sII32s", 44
FOOTER, FOOTER_BYTES = "<QQQI4s", 32
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u8"), ("ids", "<u8")])
#: The dictionary is trained on about so many documents (twice as many at most), and has so many bytes at most.
SAMPLE_DOCUMENTS, DICTIONARY_BYTES = 1000, 64 * 1024
LEVEL = 3
#: Of a sampled document so many ids at most are training material; whole texts are written.
SAMPLE_IDS = 4096
MANIFEST = "shard long, file string, documents long, ids long"


@dataclass(frozen=True)
class TokenFiles:
    """Written files: their folder, the committed manifest and the dictionary's sha256."""

    folder: str
    manifest: DataFrame
    dictionary_sha256: str


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; s3a and s3n are read as s3."""
    scheme, found, rest = folder.partition("://")
    if not found:
        return pafs.LocalFileSystem(), folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def _serialized(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or plain sample content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _loaded(content: bytes) -> zstandard.ZstdCompressionDict | None:
    if len(content) < 8:
        return None
    loaded = zstandard.ZstdCompressionDict(content)
    loaded.precompute_compress(level=LEVEL)
    return loaded


def write(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    vocabulary: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    word_ends: bool = True,
) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write the shards of a new folder."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )

    # about SAMPLE_DOCUMENTS documents, drawn by a hash: the same ones on every run
    share = SAMPLE_DOCUMENTS / max(1, rows.count())
    drawn = rows.where(F.xxhash64("doc_id", "text") < F.lit(min(2.0**63, (share - 0.5) * 2.0**64)))
    sample = drawn.select(F.substring("text", 1, 8 * SAMPLE_IDS).alias("text")).limit(2 * SAMPLE_DOCUMENTS).collect()
    encoded = cached_tokenizer(tokenizer_path, word_ends).encode([r.text for r in sample])
    content = _dictionary([_serialized(e[: 4 * SAMPLE_IDS] + little_u4(end_id), width) for e in encoded])
    sha = hashlib.sha256(content).digest()
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(content)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        files = file_system(folder)[0]
        tokens = cached_tokenizer(tokenizer_path, word_ends)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(content), write_content_size=True)
        index, total, at = [], 0, HEADER_BYTES
        out = None
        for batch in slices_by_size(batches, 1):
            if out is None:
                out = files.open_output_stream(f"{root}/{name}")
                out.write(struct.pack(HEADER, MAGIC, 1, width, sha))
            doc_ids = batch.column(0).to_pylist()
            entries = np.zeros(len(doc_ids), INDEX)
            for k, (doc_id, ids) in enumerate(zip(doc_ids, tokens.encode(batch.column(1).to_pylist()))):
                frame = packer.compress(_serialized(ids + little_u4(end_id), width))
                out.write(frame)
                entries[k] = (doc_id or 0, doc_id is None, at, len(frame), len(ids) // 4 + 1)
                at += len(frame)
            index.append(entries)
            total += int(entries["ids"].sum())
        if out is None:
            return
        table = np.concatenate(index).tobytes()
        out.write(table)
        out.write(struct.pack(FOOTER, at, len(table) // INDEX.itemsize, total, zlib.crc32(table), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": [task.partitionId()], "file": [name], "documents": [len(table) // INDEX.itemsize], "ids": [total]}
        )

    # ranges of the id, sized by adaptive execution; the text only breaks ties
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest_path = f"{folder.rstrip('/')}/manifest"
    sorted_rows.mapInArrow(shard, MANIFEST).write.parquet(manifest_path)
    return TokenFiles(folder, spark.read.schema(MANIFEST).parquet(manifest_path), sha.hex())


class ShardReader:
    """One shard file: whole scans, or single documents through the index."""

    def __init__(self, folder: str, file: str):
        fs, root = file_system(folder)
        self.source = fs.open_input_file(f"{root}/{file}")
        self.source.seek(self.source.size() - FOOTER_BYTES)
        at, count, self.ids, check, magic = struct.unpack(FOOTER, self.source.read(FOOTER_BYTES))
        self.source.seek(0)
        first, _, self.width, sha = struct.unpack(HEADER, self.source.read(HEADER_BYTES))
        with fs.open_input_stream(f"{root}/dictionary") as stream:
            content = stream.read()
        if magic != MAGIC or first != MAGIC or hashlib.sha256(content).digest() != sha:
            raise ValueError(f"{file} is no token file of this dictionary")
        self.source.seek(at)
        table = self.source.read(count * INDEX.itemsize)
        if zlib.crc32(table) != check:
            raise ValueError(f"{file} has a damaged index")
        self.index = np.frombuffer(table, INDEX)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_loaded(content))

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard, by reading its frame alone."""
        entry = self.index[k]
        self.source.seek(int(entry["offset"]))
        data = self.unpacker.decompress(self.source.read(int(entry["size"])))
        return np.frombuffer(data, f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with this id."""
        known = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["null"] == 0))
        return self.document(int(known[0])) if len(known) else None


def read_digest(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    folder = files.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                reader = ShardReader(folder, file)
                crc = np.fromiter((crc32_of(reader.document(k)) for k in range(len(reader.index))), np.int64)
                n = reader.index["ids"].astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(reader.index["doc_id"].astype(np.int64), mask=reader.index["null"] == 1),
                        "start": start + np.cumsum(n) - n,
                        "n_tokens": n,
                        "ids_crc32": crc,
                    }
                )

    # the window sees one small row for each file, not for each document
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = files.manifest.withColumn("start", F.coalesce(before, F.lit(0)))
    # one file for each task: the manifest's rows are few, their files are not
    tasks = max(1, files.manifest.count())
    return shards.repartitionByRange(tasks, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_ids(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id and the whole id array of every document."""
    folder = files.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                reader = ShardReader(folder, file)
                for k, entry in enumerate(reader.index):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if entry["null"] else int(entry["doc_id"])], pa.int64()),
                            pa.array([reader.document(k).astype(np.int64)], pa.list_(pa.int64())),
                        ],
                        ["doc_id", "ids"],
                    )

    return files.manifest.repartition("shard").mapInArrow(read, "doc_id long, ids array<long>")
