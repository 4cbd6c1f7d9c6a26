"""The pipeline's stages against the same stages written out by hand."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_models import brute_chain
from test_search_and_copies import brute_classes, brute_print
from test_text_operators import crc, library

from wellspring.llm import language, toxicity
from wellspring.llm.common import FOLDERS, discard, written
from wellspring.llm.queries import TOKENIZERS, TOXICITY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(
    not (os.path.isdir(SF_DIR) and os.path.isdir(TOKENIZERS)), reason="driver tables or vocabularies not present"
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The driver's tables with copies, near copies, nulls and texts without a letter added."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    long = max((r for r in rows if len(r[1]) < 20_000), key=lambda r: len(r[1]))
    rows += [(9000, long[1], *long[2:]), (9001, long[1] + " end", *long[2:]), (9002, "12 34", "en", "s", 5)]
    rows += [(9003, None, None, None, None), (9004, "", "en", "s", 0), rows[0]]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "language_id", "exact_dedup", "simhash_near_dedup", "bin_slack_packing"
    ]


def test_result_equals_the_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), TOXICITY)
    clean = docs.where("true").collect()
    clean = [r for r in clean if brute_chain(chain, r.text)[1] < 0.5]
    network = language.fit(spark.createDataFrame(clean, docs.schema))
    names, scores = language.labeller(network)([r.text for r in clean])
    known = [r for r, n, s in zip(clean, names, scores) if n != "und" and s >= 0.4]
    last = {}
    for r in known:
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    single = {i: t for t, i in last.items()}
    classes = brute_classes({brute_print(t) for t in single.values()})
    least = {}
    for i, t in single.items():
        c = classes[brute_print(t)]
        least[c] = min(i, least.get(c, i))
    kept = {i: single[i] for i in least.values()}
    ids = dict(zip(kept, (x + [0] for x in library("byte_bpe_50k.json", list(kept.values())))))
    want = Counter(
        (i, s, len(x[s : s + 1024]), crc(x[s : s + 1024]), len(x)) for i, x in ids.items() for s in range(0, len(x), 1024)
    )
    before = list(FOLDERS)
    got = corpus_pipeline.run(spark, folder).collect()
    assert FOLDERS[:-1] == before and os.path.isdir(FOLDERS[-1].removeprefix("file:"))  # only the result stays
    assert Counter(tuple(r)[:5] for r in got) == want
    assert 9000 not in kept or 9001 not in kept
    filled = np.bincount([r.sequence_id for r in got], [r.length for r in got])
    assert filled.max() <= 1024 and (filled > 0).all()


def test_empty_tables_and_odd_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0

    odd = str(tmp_path / "odd")
    rows = [tuple(r) for r in docs.limit(40).collect()]
    rows += [(None, "word " * 50_000, "en", "s", 1), (None, None, None, None, None), (7, "x" * 300_000, None, None, None)]
    wide = spark.createDataFrame(rows, docs.schema)
    for name in ("kept", "length", "sequence_id", "fingerprint", "spans"):
        wide = wide.withColumn(name, wide["n_chars"])
    wide.write.parquet(f"{odd}/documents.parquet")
    labels.withColumn("text", labels["toxic"]).write.parquet(f"{odd}/labels.parquet")
    packed = corpus_pipeline.run(spark, odd)
    assert packed.where("length > 1024").count() == 0 and packed.count() > 0


def test_discarded_tables_are_gone(spark):
    before = len(FOLDERS)
    kept = written(spark.range(3))
    gone, last = written(spark.range(4)), written(spark.range(5))
    paths = FOLDERS[before:]
    discard(spark, since=before + 1, keep=1)
    assert [os.path.isdir(p.removeprefix("file:")) for p in paths] == [True, False, True]
    assert kept.count() == 3 and last.count() == 5 and gone.schema == kept.schema
    discard(spark, since=before)
    assert FOLDERS[before:] == []
