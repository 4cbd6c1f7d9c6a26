"""Searches, near copies and repeated lines against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wellspring.llm import kdtree, line_dedup, simhash


def brute_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[k : k + words]) for k in range(len(tokens) - words + 1)] or [b" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints: set[int], distance: int = 2) -> dict[int, int]:
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    held = sorted(prints)
    for i, a in enumerate(held):
        for b in held[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in held}


def signed(p: int) -> int:
    return p - (1 << 64) if p >> 63 else p


def test_large_components_that_cancel_lose_no_row():
    """Sums whose terms are 1e18 and whose value is small: rounding exceeds the value."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-50, 50, (3000, 6))
    vectors[:, :2] = 10**9
    queries = rng.integers(-50, 50, (100, 6))
    queries[:, 0], queries[:, 1] = 10**9, -(10**9)
    ids = np.arange(3000)
    tree = kdtree.Tree.build(ids, vectors, leaf=32)
    unknown = np.full(100, kdtree.UNKNOWN)
    for (_, found, scores), query in zip(tree.search(queries, np.full(100, -1), 20, unknown), queries):
        exact = vectors @ query
        best = np.lexsort((ids, -exact))[:20]
        assert found.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()


def test_scores_beyond_the_doubles_are_ranked_exactly(spark):
    rows = [(k, [float(2**14), float(k % 5)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = kdtree.top_k(df, "vec_id = 3", k=8, scale=float(1 << 16), shard_rows=10).collect()
    q = [[int(x * (1 << 16)) for x in v] for _, v in rows]
    want = sorted(((-sum(a * b for a, b in zip(q[3], q[k])), k) for k in range(60) if k != 3))[:8]
    got = {(r.rank, r.vec_id, r.score) for r in out}
    assert got == {(i + 1, k, -s) for i, (s, k) in enumerate(want)}


def test_fingerprint_equals_the_hash_of_the_engine(spark):
    text = "The Quick  brown\tfox"
    want = spark.sql("SELECT xxhash64('quick brown fox') AS h").first().h % (1 << 64)
    assert want == xxhash.xxh64_intdigest(b"quick brown fox", 42)
    assert simhash.fingerprint(text.encode()) == brute_print(text)


@pytest.mark.parametrize("width", [1, 3, 1000])
@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_lose_no_pair(spark, width, distance):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    for base in list(prints)[:12]:
        for _ in range(12):
            base ^= 1 << rng.randrange(64)
            prints.add(base)
            prints.add(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = simhash.links(df, distance, bucket_width=width)
    pairs = {(r.a, r.b) for r in found.collect()}
    assert all(a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in pairs)
    roots = {r.node: r.root for r in simhash.components(found).collect()}
    want = Counter(brute_classes(prints, distance).values())
    got = Counter(roots.get(signed(p), signed(p)) for p in prints)
    assert sorted(got.values()) == sorted(want.values())


def test_segment_radii_cover_the_distance():
    assert simhash.segment_radii(2, 2) == [1, 0]
    assert simhash.segment_radii(2, 4) == [0, 0, 0, -1]


@pytest.mark.parametrize("segments", [1, 2, 4])
def test_near_duplicates(documents, odd, segments):
    if segments == 1:
        segments = 2
    rng = random.Random(3)
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    rows = list(odd)
    for k in range(60):
        words = list(base)
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = f"other{k}"
        rows.append((200 + k, " ".join(words)))
    got = simhash.near_duplicates(documents(rows), segments=segments, bucket_width=4).collect()
    classes = brute_classes({brute_print(t) for _, t in rows})
    least = {}
    for i, t in rows:
        if i is not None:
            c = classes[brute_print(t)]
            least[c] = min(i, least.get(c, i))
    want = {(i, f"{brute_print(t):016x}", least.get(classes[brute_print(t)])) for i, t in rows}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_keep_first_and_empty(documents):
    df = documents([(5, "a b c d"), (3, "A b  c d"), (9, "entirely different words here"), (7, None)])
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [3, 7, 9]
    assert simhash.near_duplicates(documents([])).count() == 0


def brute_top(rows, k=20, scale=64):
    usable = [
        (i, [int(np.floor(float(x) * scale)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in {i: a for i, a in sorted(usable)}.items():
        if q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shard_rows,block_rows", [(10_000, 10_000), (60, 5)])
def test_top_k(spark, shard_rows, block_rows):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(0, 0.3, 6).round(2).tolist()) for k in range(400)]
    rows += [(400 + k, rows[20][1]) for k in range(50)]  # a very common vector: ties
    rows += [(500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] + [0.0] * 5)]
    rows += [(None, [1.0] * 6), (580, [0.5, 0.25]), (600, [1e6] * 6), (601, [-1e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("shard", F.lit(2))
    got = kdtree.top_k(df, "vec_id % 20 = 0", shard_rows=shard_rows, block_rows=block_rows).collect()
    assert {tuple(r) for r in got} == brute_top(rows) and len(got) == len(brute_top(rows))


def test_top_k_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(20, [1.0, 2.0]), (20, [1.0, 2.0]), (21, [0.5, 0.5])], schema)
    assert [tuple(r) for r in kdtree.top_k(few, "vec_id % 20 = 0").collect()] == [(20, 1, 21, 64 * 32 + 128 * 32)]
    assert kdtree.top_k(few.limit(0), "vec_id % 20 = 0").count() == 0


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(2)
    tree = kdtree.Tree.build(np.arange(1000), rng.normal(size=(1000, 5)), leaf=10)
    for (start, stop), low, high, left in zip(tree.rows, tree.low, tree.high, tree.left):
        assert (tree.vectors[start:stop].min(0) == low).all() and (tree.vectors[start:stop].max(0) == high).all()
        assert left >= 0 or stop - start <= 10


def brute_lines(rows, min_lines, min_words):
    first, spans = {}, []
    for i, t in sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh128_digest(r[1] or ""))):
        kept = [(k, x.strip()) for k, x in enumerate((t or "").split("\n")) if x.strip()]
        for a in range(len(kept)):
            for b in range(a, len(kept)):
                if b - a + 1 >= min_lines or sum(len(x.split()) for _, x in kept[a : b + 1]) >= min_words:
                    content = tuple(x for _, x in kept[a : b + 1])
                    if first.setdefault(content, (i, t, a)) != (i, t, a):
                        spans.append((i, t, kept[a][0], kept[b][0]))
                    break
    out = []
    for i, t in rows:
        gone = {k for j, u, a, b in spans if (j, u) == (i, t) for k in range(a, b + 1)}
        lines = (t or "").split("\n")
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
        out.append((i, len(lines) if t else 0, tuple(sorted(gone)), text))
    return Counter(out)


@pytest.mark.parametrize("min_lines,min_words", [(3, 50), (2, 8), (1, 1)])
def test_repeated_lines(documents, odd, min_lines, min_words):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 12))) for _ in range(25)]
    rows = list(odd)
    for k in range(60):
        start, n = rng.randrange(20), rng.randrange(0, 8)
        body = [f"own {k}", *lines[start : start + n], f"end {k}", "very common line", *rng.choices(lines, k=3)]
        rows.append((100 + k, "\n".join(body)))
    got = line_dedup.delete_repeats(documents(rows), min_lines, min_words).collect()
    seen = Counter((r.doc_id, r.n_lines, tuple(k for d in r.deleted for k in range(d["first"], d["last"] + 1)), r.text) for r in got)
    assert seen == brute_lines(rows, min_lines, min_words)
    assert line_dedup.delete_repeats(documents([])).count() == 0


def test_only_window_minima_are_selected(documents):
    rows = [(k, "\n".join(f"line {(k * 13 + n) % 50}" for n in range(60))) for k in range(9)]
    found = line_dedup.positions(documents(rows), 4, 1000).collect()
    digests = [[xxhash.xxh128_digest(x) for x in t.split("\n")] for _, t in rows]
    hashes = [[int.from_bytes(d[:8], "little", signed=True) for d in ds] for ds in digests]
    want = {(i, max(a for a in range(k, k + 4) if h[a] == min(h[k : k + 4]))) for i, h in enumerate(hashes) for k in range(57)}
    assert {(r.doc_id, r.line) for r in found} == want and len(found) == len(want) < 9 * 60 * 0.6
    for r in found:
        held = [(r.line - w.before, r.line + w.after) for w in r.windows]
        assert bytes(r.around) == b"".join(digests[r.doc_id][held[0][0] : held[-1][1] + 1])
        assert all(b - a == 3 for a, b in held) and r.fingerprint == hashes[r.doc_id][r.line]
    spans = sorted((r.doc_id, r.line - w.before) for r in found for w in r.windows)
    assert spans == [(i, k) for i in range(9) for k in range(57)]


def test_a_long_run_is_one_match(documents):
    passage = [f"passage {k}" for k in range(40)]
    hot = ["hot", "hot", "hot"]
    rows = [
        (1, "\n".join(["a 1", *passage, *hot, "a 2"])),
        (2, "\n".join(["b 1", "", *passage[5:30], "b 2", *hot, *passage[:4]])),
        (3, "\n".join(["c 1", *passage[5:30], "b 2", *hot])),
    ]
    got = {(r.doc_id, r.first, r.last, r.earlier.doc_id, r.earlier.first) for r in line_dedup.matches(documents(rows)).collect()}
    assert got == {
        (2, 1, 25, 1, 6),
        (2, 27, 29, 1, 41),
        (2, 30, 33, 1, 1),
        (3, 1, 25, 1, 6),
        (3, 24, 28, 2, 24),
        (3, 27, 29, 1, 41),
    }


def test_windows_inside_spans():
    found = [(0, 0), (1, 3), (2, 4), (3, 5), (6, 6)]
    assert line_dedup.inside(found, [(3, 5), (0, 2), (6, 9)]) == [(0, 0), (3, 5), (6, 6)]
    assert line_dedup.inside(found, [(1, 4), (0, 0)]) == [(0, 0), (1, 3), (2, 4)]
    assert line_dedup.inside([], [(0, 9)]) == line_dedup.inside(found, []) == []
