"""Decontamination, periodic runs and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wellspring.llm import decontaminate, manifest, periodic
from wellspring.llm.queries import planted_runs


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# Periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] == words[i + q]:
                start = i
                while i + q < len(words) and words[i] == words[i + q]:
                    i += 1
                if i - start + q >= max(6, 4 * q):
                    found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repeats(rng, most):
    words = []
    for _ in range(rng.randrange(0, 6)):
        letters = rng.choice([1, 2, 3, 50])
        base = [rng.randrange(letters) for _ in range(rng.randrange(1, most))]
        words += [base[j % len(base)] for j in range(int(len(base) * rng.choice([1, 3.9, 4, 4.1, 6.5])))]
    return words


def test_runs_equal_brute_force_at_every_scale():
    rng = random.Random(3)
    for most in (4, 20, 40, 90, 180):
        texts = [repeats(rng, most) for _ in range(40)]
        assert periodic.find_runs([np.array(t, np.int64) for t in texts]) == [brute_runs(t) for t in texts]


def test_shortest_run_of_each_period_is_found_at_any_place():
    for q in range(1, 70):
        for shift in (0, 1, 7):
            words = list(range(-9, -9 + shift)) + [100 + i % q for i in range(max(6, 4 * q))] + [-50, -51]
            want = [(shift, max(6, 4 * q), q)]
            assert periodic.find_runs([np.array(words, np.int64) + 1000]) == [want]
            short = words[: shift + max(6, 4 * q) - 1]
            assert periodic.find_runs([np.array(short, np.int64) + 1000]) == [[]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_runs_of_few_words(words):
    assert periodic.find_runs([np.array(words, np.int64)]) == [brute_runs(words)]


def test_long_text_with_one_run_is_found_whole():
    base = list(range(5000))
    words = np.array([-7] + base * 9 + [-8], np.int64) + 10
    assert periodic.find_runs([words]) == [[(1, 45_000, 5000)]]


def test_detect_and_collapse(spark, documents, odd):
    rows = odd + [(20, "a b\x1ca b " * 3), (21, "x " + "p q r " * 5 + "z"), (22, "p q " * 9)]
    found = periodic.detect(documents(rows))
    got = Counter((r.c0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect())
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        want.append((i, len(words), tuple(runs), kept))
    assert got == Counter(want)
    df = documents(rows)
    out = periodic.collapse(df)
    assert out.columns == df.columns
    assert Counter(r[1] for r in out.collect()) == Counter(w[3] for w in want)
    assert periodic.detect(documents([])).count() == 0


def test_planted_runs(spark, documents):
    import zlib

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 50))) for i in range(300)] + [(None, "a b"), (10, None)]
    got = Counter((r.doc_id, r.text) for r in planted_runs(documents(rows, extra=False).select("doc_id", "text")).collect())
    want = []
    for i, t in rows:
        words = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n))
        want.append((i, t))
    assert got == Counter(want)
    assert any(a != b for a, b in zip(rows, want))


# Decontamination


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_hits(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[k : k + window])].add(item)
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])] - {None}
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return Counter(out)


def hits(spark, documents, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    for name in ("token", "window", "size", "row", "ITEM"):
        bench = bench.withColumn(name, F.lit(1))
    rows = decontaminate.contaminated(documents(docs), bench, **options).collect()
    flat = lambda r: tuple(k for s in r.spans for k in range(s.start, s.end))
    return Counter((r.id, r.n_words, flat(r), tuple(sorted(r["items"]))) for r in rows)


def test_hits_equal_brute_force(spark, documents, odd):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["a", "b", "c"]) for _ in range(n))
    items = [(k, say(rng.choice([12, 14, 25]))) for k in range(12)] + [(12, "Lone"), (13, "two Words"), (14, say(7)), (15, None), (16, " -- ")]
    items += [(k, items[0][1]) for k in (30, 31, 31)] + [(None, say(11))]
    docs = [(100 + k, say(rng.randrange(0, 60)) + "," + items[k % 16][1][: rng.randrange(0, 60)] if items[k % 16][1] else None) for k in range(60)]
    docs += odd + [(500, "lone. LONE"), (501, "É two words é"), (501, items[3][1]), (502, items[0][1] + " " + items[0][1])]
    assert hits(spark, documents, docs, items) == brute_hits(docs, items)


def test_hits_without_broadcast_and_with_a_hot_passage(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(k, f"u{k} {passage} v{k}" if k % 3 == 0 else f"p1 p2 p3 p4 p5 p6 p7 x{k} p3 p4 p5 p6 p7 p8") for k in range(90)]
    items = [(k, passage) for k in range(40)] + [(99, "q " * 20)]
    docs += [(200, None), (201, ""), (None, passage), (202, "lone q q")]
    items += [(100, "lone"), (101, "q q q")]
    assert hits(spark, documents, docs, items) == brute_hits(docs, items)


def test_no_items_and_no_documents(spark, documents):
    assert hits(spark, documents, [(1, "a b")], []) == Counter([(1, 2, (), ())])
    assert hits(spark, documents, [(1, "a b")], [(1, None), (2, "!")]) == Counter([(1, 2, (), ())])
    assert hits(spark, documents, [], [(1, "a b")]) == Counter()


def test_the_plan_is_native(spark, documents):
    df = decontaminate.contaminated(documents([(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


# Merkle manifest


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(hashes):
    """Root, and for every leaf its (left, right) siblings."""
    paths, level = [[] for _ in hashes], [(h, [i]) for i, h in enumerate(hashes)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 3):
            run = level[k : k + 3]
            for j, (_, under) in enumerate(run):
                for i in under:
                    paths[i].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            above.append((sha("".join(h for h, _ in run)), [i for _, u in run for i in u]))
        level = above
    return level[0][0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], sha("".join(map(enc, r)))))
    trees = {}
    for g, leaves in groups.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = (leaves, *brute_tree([h for _, h in leaves]))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root, upper = brute_tree([trees[g][1] for g in order])
    out = Counter()
    for g, above in zip(order, upper):
        leaves, subroot, paths = trees[g]
        for (i, leaf), path in zip(leaves, paths):
            out[i, leaf, subroot, root, tuple(path + above)] += 1
    return out


def as_rows(df):
    return Counter((r.id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in df.collect())


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.fixture(scope="module")
def sourced(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        for name in ("tree", "node", "number", "f0", "id"):
            df = df.withColumn(name, F.lit("x"))
        return df.withColumn("PATH", F.lit(1))

    return make


def test_manifest_equals_brute_force(spark, sourced, monkeypatch):
    monkeypatch.setattr(manifest, "DIGITS", 2)  # nine nodes a block: several rounds
    rng = random.Random(2)
    sizes = {None: 2, "": 1, "a": 100, "b": 9, "é": 10, "z": 28, "Z": 3, "one": 1} | {f"s{k}": 2 for k in range(12)}
    rows = [(rng.randrange(400), g, rng.choice(["en", None]), k, rng.choice([None, "", "x\ny", f"t{k}é"])) for g, n in sizes.items() for k in range(n)]
    rows += [(None, "a", None, None, None), (7, "b", "en", 1, "same"), (7, "b", "en", 1, "same"), (7, "b", "en", 1, "other"), (8, "a", "de", 1, "x" * 200_000)]
    got = manifest.manifest(sourced(rows))
    assert as_rows(got) == brute_manifest(rows)
    folded = got.select("root", manifest.folded(F.col("found"), F.col("path")).alias("f"))
    assert folded.where("f <> root").count() == 0


def test_manifest_of_small_tables(spark, sourced):
    for rows in ([], [(1, "s", "en", 1, "t")], [(1, None, None, None, None)], [(1, "s", "en", 1, "t"), (2, "r", "en", 1, "t")], [(k, "s", "en", 1, "t") for k in range(4)]):
        got = as_rows(manifest.manifest(sourced(rows)))
        assert got == (brute_manifest(rows) if rows else Counter())


def test_changed_rows_do_not_verify(spark, sourced):
    rows = [(k, "s", "en", 1, f"a{k}\n" if k % 2 else f"a{k}") for k in range(20)]
    changed = manifest.manifest(sourced(rows), found={"text": F.translate("f4", "\n", "")})
    ok = {r.id: r.f == r.root for r in changed.select("id", "root", manifest.folded(F.col("found"), F.col("path")).alias("f")).collect()}
    assert ok == {k: k % 2 == 0 for k in range(20)}


def test_proofs_are_emitted_without_joins(spark, sourced):
    plan = manifest.manifest(sourced([(1, "s", "en", 1, "t")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate explode" in plan
