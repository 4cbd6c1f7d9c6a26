"""Operators on texts against brute force, the libraries and exact round trips."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wellspring.llm import bpe_tree, grace_dedup, packing, sharding, token_files
from wellspring.llm.common import CachedTokenizer, space_chunks
from wellspring.llm.queries import PATTERN, TOKENIZERS, vocabulary

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="public vocabularies not present")
PIECES = ["the ", "tion", " a", "é", "ß", " \n", "  ", "'s", "12", "!?", "日本", "\x1c", "\x01", "İ", "word,", " Word"]


def library(name: str, texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def ranks():
    return bpe_tree.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def tiktoken_ids(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_chunks_join_to_the_text_and_keep_matches(text):
    import regex

    chunks = space_chunks(text)
    assert "".join(chunks) == text
    assert [m for c in chunks for m in regex.findall(PATTERN, c)] == regex.findall(PATTERN, text)


def test_cached_tokenizer_equals_the_library():
    rng = random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(0, 60))) for _ in range(400)]
    for name, word_ends in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        tokenizer = CachedTokenizer(vocabulary(name), word_ends)
        for _ in range(2):  # learned, then remembered
            assert [np.frombuffer(b, "<u4").tolist() for b in tokenizer.encode(texts)] == library(name, texts)


def test_tree_of_merges_equals_direct_merges(ranks, tiktoken_ids):
    rng, tree = random.Random(5), bpe_tree.MergeTree(ranks, leaf=4)
    for _ in range(300):
        data = "".join(rng.choices(rng.choice(["ab", "the n", "aeiounst", "éü日", "0.-"]), k=rng.randrange(1, 200)))
        ids = tree._halves(data.encode())
        assert ids == tree._merged_long(data.encode()) == tree.merged(data.encode())
        assert tree.decode(ids) == data.encode()


def test_tree_with_few_ranks_and_overlapping_pairs():
    tokens = [bytes([b]) for b in range(256)] + [b"aa", b"aaa", b"ab", b"aaaa", b"ba", b"bab", b"abab"]
    tree = bpe_tree.MergeTree({t: i for i, t in enumerate(tokens)}, leaf=2)
    for n in range(1, 9):
        for k in range(2**n):
            data = bytes(b"ab"[k >> i & 1] for i in range(n))
            assert tree._halves(data) == tree.merged(data)


def test_encode_decode_and_digest(spark, documents, odd, tiktoken_ids):
    df = documents(odd)
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_tree.encode(df, path, PATTERN)
    want = Counter((i, tuple(tiktoken_ids(t or ""))) for i, t in odd)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    decoded = Counter((r.doc_id, bytes(r.decoded)) for r in bpe_tree.decode(encoded, path).collect())
    assert decoded == Counter((i, (t or "").encode()) for i, t in odd)
    digest = bpe_tree.round_trip_digest(df, path, PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter(map(tuple, digest)) == Counter(
        (i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
        for i, t in odd
        for ids in [tiktoken_ids(t or "")]
    )
    assert bpe_tree.round_trip_digest(documents([]), path, PATTERN).count() == 0


def test_decoding_is_a_tree_reduction(ranks, monkeypatch):
    rng, tree = random.Random(4), bpe_tree.MergeTree(ranks)
    ids = [rng.randrange(1000) for _ in range(5000)]
    flat = b"".join(tree.bytes_of[i] for i in ids)
    leaves = []
    monkeypatch.setattr(bpe_tree, "LEAF_IDS", 7)
    plain = bpe_tree.MergeTree.decode
    monkeypatch.setattr(bpe_tree.MergeTree, "decode", lambda self, x: (len(x) <= 7 and leaves.append(len(x))) or plain(self, x))
    assert tree.decode(ids) == flat and sum(leaves) == 5000 and max(leaves) <= 7
    assert tree.decode([]) == b"" and tree.decode(ids[:123]) + tree.decode(ids[123:]) == flat


def test_digests_decode_the_ids_of_the_document(ranks):
    encoder = bpe_tree.TextEncoder(ranks, PATTERN)
    text = "the cat and the dog " * 200
    n, decimals, data = encoder.digested(text)
    ids = [int(i) for i in decimals.decode().split(",")[:-1]]
    assert data == text.encode() and n == len(ids)
    encoder.tree.bytes_of[ids[0]] = b"?"
    assert encoder.digested(text)[2] == b"".join(encoder.tree.bytes_of[i] for i in ids) != data



def test_token_files_round_trip(spark, documents, odd):
    rows = odd + [(100 + k, f"document number {k} of many") for k in range(60)]
    files = token_files.write(documents(rows), vocabulary("word_bpe_49k.json"), end_id=1, vocabulary=49_408)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [x + [1] for x in library("word_bpe_49k.json", [t or "" for _, t in ordered])]
    start = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    want = Counter((i, s, len(x), crc(x)) for (i, _), s, x in zip(ordered, start, ids))
    assert Counter(map(tuple, token_files.read_digest(files).collect())) == want
    whole = {(r.doc_id, tuple(r.ids)) for r in token_files.read_ids(spark, files).collect()}
    assert whole == {(i, tuple(x)) for (i, _), x in zip(ordered, ids)}
    shard = next(r.file for r in files.manifest.collect())
    reader = token_files.ShardReader(files.folder, shard)
    one = int(reader.index["doc_id"][-1])
    assert reader.find(one).tolist() in [x for (i, _), x in zip(ordered, ids) if i == one]
    assert reader.find(10**9) is None


def test_token_files_refuse_another_dictionary(spark, documents, tmp_path):
    files = token_files.write(documents([(1, "a b c")]), vocabulary("word_bpe_49k.json"), 1, 49_408, f"file://{tmp_path}/x")
    (tmp_path / "x" / "dictionary").write_bytes(b"something else")
    with pytest.raises(ValueError):
        token_files.ShardReader(files.folder, files.manifest.first().file)


def test_token_files_of_an_empty_table(documents):
    files = token_files.write(documents([]), vocabulary("word_bpe_49k.json"), 1, 49_408)
    assert token_files.read_digest(files).count() == 0


def test_exact_groups(documents, odd):
    def want(rows):
        groups = {}
        for i, t in rows:
            groups.setdefault(t or "", []).append(i)
        out = set()
        for text, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            sha = hashlib.sha256(text.encode()).hexdigest()
            out |= {(i, keep, len(ids), i == keep, sha) for i in ids}
        return out

    got = grace_dedup.exact_groups(documents(odd)).collect()
    assert {tuple(r) for r in got} == want(odd) and len(got) == len(want(odd))
    # tables of a few records: several levels of spill files
    rows = [(k, f"text {k % 700}" * 5) for k in range(3000)]
    got = grace_dedup.exact_groups(documents(rows), table_bytes=3000).collect()
    assert {tuple(r) for r in got} == want(rows)
    assert grace_dedup.exact_groups(documents([])).count() == 0


def test_grace_levels_leave_no_file(tmp_path):
    records = [(k * 7919 % 50 << 40, b"%d" % (k % 200), k, 1) for k in range(1000)]
    found = list(grace_dedup.grace_groups(records, str(tmp_path), limit=2000))
    assert {(c, n) for _, c, _, n in found} == {(b"%d" % k, 5) for k in range(200)}
    assert {c: g for _, c, g, _ in found} == {b"%d" % k: 800 + k for k in range(200)}
    assert not list(tmp_path.iterdir())


def test_keep_one_returns_all_columns(documents, odd):
    df = documents(odd)
    kept = grace_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r[0], len(r[1] or "")) for r in kept.collect()) == [
        (2, 16), (4, 0), (5, 4), (6, 200_000), (7, 150_000), (8, len(odd[10][1])), (9, 7)
    ]


def test_hypergeometric_moments_and_limits():
    rng = np.random.default_rng(0)
    for good, bad, drawn in ((10, 5, 6), (3, 300, 50), (10**12, 3 * 10**12, 10**6)):
        seen = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(1500)])
        total = good + bad
        mean = drawn * good / total
        spread = np.sqrt(mean * bad / total * (total - drawn) / (total - 1))
        assert abs(seen.mean() - mean) < 5 * spread / np.sqrt(len(seen))
        assert 0.85 < seen.std() / spread < 1.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3
    matrix = sharding.communication_matrix([7, 0, 100, 13], [30, 30, 30, 30], 1)
    assert matrix.sum(axis=1).tolist() == [7, 0, 100, 13] and matrix.sum(axis=0).tolist() == [30] * 4


def test_shards(documents, odd, monkeypatch):
    rows = odd + [(100 + k, f"t{k % 5}") for k in range(500)]
    for size in (1_000_000, 20):
        monkeypatch.setattr(sharding, "PARTITION_ROWS", size)
        got = sharding.deal(documents(rows), shards=16).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
        )
        by_shard = {}
        for r in got:
            by_shard.setdefault(r.shard, []).append(r.slot)
        assert {len(s) for s in by_shard.values()} <= {len(rows) // 16, len(rows) // 16 + 1}
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
        assert set(by_shard) == set(range(16))
    assert sharding.deal(documents([])).count() == 0


def test_shards_mix_partitions(documents, monkeypatch):
    monkeypatch.setattr(sharding, "PARTITION_ROWS", 100)
    got = sharding.deal(documents([(k, "x") for k in range(1600)], extra=False), shards=4).collect()
    halves = Counter((r.shard, r.doc_id < 800) for r in got)
    assert all(140 < n < 260 for n in halves.values())
    early = Counter(r.doc_id < 800 for r in got if r.slot < 200)
    assert 300 < early[True] < 500


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(0, 40))
def test_fullest_is_the_best_subset_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    chosen = packing.fullest(counts, room)
    assert sum(n * c for n, c in chosen.items()) == max(sums)
    assert all(c <= counts[n] for n, c in chosen.items())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=12))
def test_plan_uses_every_length_once(counts):
    windows = packing.plan(counts, 64)
    used = Counter()
    for window, times in windows:
        assert sum(n * c for n, c in window.items()) <= 64
        used.update({n: c * times for n, c in window.items()})
    assert used == Counter(counts)


def test_packing(documents, odd, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 15)
    rows = odd + [(100 + k, "some words here " * (k % 90)) for k in range(150)]
    packed = packing.pack_documents(documents(rows), vocabulary("byte_bpe_50k.json"), 0, 128, with_ids=True)
    got = packed.collect()
    ids = [x + [0] for x in library("byte_bpe_50k.json", [t or "" for _, t in rows])]
    want = Counter(
        (i, s, len(x[s : s + 128]), crc(x[s : s + 128]), len(x)) for (i, _), x in zip(rows, ids) for s in range(0, len(x), 128)
    )
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(map(len, ids))
    assert len(bins) * 128 < 1.05 * total + 128
    whole = packing.sequences(packed, 128).collect()
    assert all(len(r.ids) == 128 for r in whole) and sum(r.n_ids for r in whole) == total
    assert packing.pack_documents(documents([]), vocabulary("byte_bpe_50k.json"), 0).count() == 0
