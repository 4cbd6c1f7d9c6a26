"""Byte-level BPE as a tree reduction: halves are encoded alone and joined at their border.

Ids of a byte string by rank merges are the only sequence of tokens in which every two
neighbours are what their own joined bytes encode to: merges inside a pair's bytes do not
depend on bytes outside it, as long as no merge crosses the pair's ends. So two encoded
halves are joined by re-encoding a window around the border, which grows until the pairs at
both of its ends hold; tokens outside are then final. Decoding is the same reduction with
a plain concatenation: the halves of a document's ids are decoded alone and joined up the tree.

Each match of the splitting pattern is encoded by itself; texts are cut at spaces where no
match can cross (see ``space_chunks``) and what a chunk encodes to is remembered.

Defined cases: a null text is empty; an empty text has no ids and decodes to no bytes;
repeated rows are encoded each; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import CACHE_CHUNKS, narrow, slices, space_chunks

#: Byte strings up to this length are merged directly.
LEAF_BYTES = 32
#: Ids up to this number are decoded directly.
LEAF_IDS = 256
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class MergeTree:
    """Encoder and decoder of byte strings by the ranks of their tokens."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks = ranks
        self.bytes_of = {number: token for token, number in ranks.items()}
        self.leaf = leaf
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids by merging the lowest-ranked pair, the leftmost first, until none is left."""
        if len(data) > 2 * self.leaf:
            return self._merged_long(data)
        rank, cuts = self.ranks.get, list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pairs and (lowest := min(pairs)) != _NONE:
            i = pairs.index(lowest)
            del pairs[i], cuts[i + 1]
            if i:
                pairs[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], _NONE)
            if i < len(pairs):
                pairs[i] = rank(data[cuts[i] : cuts[i + 2]], _NONE)
        return [rank(data[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same with a heap: the work does not grow with the square of the length."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # end of the token that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if not alive[i] or end[i] >= n:
                continue
            j = end[i]
            if end[j] - i != size:  # one side has grown meanwhile
                continue
            end[i], alive[j] = end[j], False
            if end[i] < n:
                before[end[i]] = i
                stop = end[end[i]]
                if (r := ranks.get(data[i:stop])) is not None:
                    heapq.heappush(heap, (r, i, stop - i))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h, end[i] - h))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def holds(self, a: int, b: int) -> bool:
        """Whether the two tokens, joined, encode to themselves."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > CACHE_CHUNKS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two encoded byte strings."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            middle = self.merged(self.decode(left[len(left) - a :] + right[:b]))
            if (a == len(left) or self.holds(left[-a - 1], middle[0])) and (
                b == len(right) or self.holds(middle[-1], right[b])
            ):
                return left[: len(left) - a] + middle + right[b:]
            width *= 2

    def encode(self, data: bytes) -> list[int]:
        """Ids of a byte string, by halves; a string that is a token is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self._halves(data)

    def _halves(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self._halves(data[:middle]), self._halves(data[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, by halves: token bytes are joined in the leaves, the halves up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class TextEncoder:
    """Ids of texts, each match of ``pattern`` encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.tree = MergeTree(ranks)
        self.matches = regex.compile(pattern).findall
        self.young: dict[str, tuple[tuple[int, ...], bytes]] = {}
        self.old: dict[str, tuple[tuple[int, ...], bytes]] = {}
        self.matched: dict[str, tuple[int, ...]] = {}

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for match in self.matches(text):
            ids = self.matched.get(match)
            if ids is None:
                ids = tuple(self.tree.encode(match.encode()))
                if len(self.matched) >= CACHE_CHUNKS:
                    self.matched.clear()
                if len(match) <= 64:
                    self.matched[match] = ids
            out += ids
        return out

    def digested(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, decimal ids each followed by a comma, and the bytes that all the ids decode to."""
        young, all_ids, decimals = self.young, [], []
        for chunk in space_chunks(text):
            entry = young.get(chunk)
            if entry is None:
                entry = self.old.get(chunk)
                if entry is None:
                    ids = self.ids(chunk)
                    # tuples of numbers, unlike lists, cost the garbage collector nothing
                    entry = tuple(ids), "".join([f"{i}," for i in ids]).encode()
                if len(chunk) <= 64:
                    young[chunk] = entry
            all_ids += entry[0]
            decimals.append(entry[1])
        if len(young) > CACHE_CHUNKS:
            self.old, self.young = young, {}
        return len(all_ids), b"".join(decimals), self.tree.decode(all_ids)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(load_ranks(ranks_path), pattern)
        for batch in slices(batches):
            ids = [[i for c in space_chunks(t or "") for i in encoder.ids(c)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<long>")


def decode(ids: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of every id array (a null array: no bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = MergeTree(load_ranks(ranks_path))
        for batch in slices(batches):
            data = [tree.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "decoded"])

    return narrow(ids, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digest(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(load_ranks(ranks_path), pattern)
        for batch in slices(batches):
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                n, decimals, data = encoder.digested(text or "")
                counts.append(n)
                ids.append(hashlib.sha256(decimals[:-1]).hexdigest())
                decoded.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
