"""Toxicity categories by a chain of linear classifiers.

Categories are label columns, predicted one after another. Each has a logistic model over
hashed features of a document's distinct words (the word and its beginnings, for stems)
and over the probabilities of the categories before it. Those probabilities are taken, in
training, from models that did not see the document (out-of-fold), so a later model learns
from earlier ones as good as they are on new text; at prediction the chain feeds itself.

The models are fitted on a bounded sample: at most ``PER_GROUP`` labelled documents of each
combination of labels, drawn by a hash of the id; a group weighs by the square root of its
true size, so that a rare one is not lost. Features of the sample are counted by label and
fold in the cluster, where those are chosen that tell the labels of some category apart;
the driver sees the chosen ones alone. Equal texts lie in one fold, so no model judges a
text that it was fitted to. Prediction reads whole texts.

Defined cases: a text that is null, empty or without a word has probability 0 in every
category; a null label keeps its document out of that category's model; labels given
twice count as their greatest; of texts with one id, the one with the least hash is learned
from; without labelled documents all probabilities are 0; a category with one label value
alone gets that value's rate; rows that repeat are scored each; an empty table stays empty;
other columns are ignored (of names in ``labels`` that differ in case, the one meant is
that spelled like the id column or as in the conditions).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import CACHE_CHUNKS, annotated, drawn, narrow, position, restored, slices, spelled, written

#: Hashed features; labelled documents of a combination of labels; folds of the chain.
FEATURES, PER_GROUP, FOLDS = 1 << 18, 2500, 3
#: Beginnings of a word that are features besides the word itself.
BEGINNINGS = (4, 5, 6)
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.25, 1e-6
#: Features used by a model: in so many sampled documents, and so telling (log ratio of rates).
LEAST_DOCUMENTS, LEAST_RATIO = 5, 2.0
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    data = ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in data]


def distinct_words(text: str | None) -> list[str]:
    return sorted(set(WORD.findall(text.lower()))) if text else []


@dataclass
class Documents:
    """Features of documents one after another; ``starts`` has one entry more than documents."""

    features: np.ndarray
    starts: np.ndarray

    def rows(self, chosen: np.ndarray) -> Documents:
        sizes = np.diff(self.starts)[chosen]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.starts[chosen] - starts[:-1], sizes) + np.arange(starts[-1])
        return Documents(self.features[at], starts)

    def only(self, kept: np.ndarray) -> Documents:
        """The same documents with the marked features alone."""
        chosen = kept[self.features]
        return Documents(self.features[chosen], np.concatenate(([0], np.cumsum(chosen)))[self.starts])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0.0], np.cumsum(weights[self.features])))[self.starts])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Logistic model over hashed features and earlier probabilities."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def margins(self, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
        return sums + before @ self.earlier + self.bias

    def predicted(self, docs: Documents, before: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margins(docs.sums(self.weights), before))


def clear(total: np.ndarray, positive: np.ndarray, known: float, labelled: float) -> np.ndarray:
    """Whether rates in documents with and without the label differ clearly.

    ``total`` and ``positive``: documents with a feature, and those of them with the label;
    ``known`` and ``labelled``: all documents, and all with the label.
    """
    ratio = np.log((positive + 1) / (labelled + 2)) - np.log((total - positive + 1) / (known - labelled + 2))
    return (total >= LEAST_DOCUMENTS) & (abs(ratio) >= LEAST_RATIO)


def telling(docs: Documents, truth: np.ndarray) -> np.ndarray:
    """Features whose rates in documents with and without the label differ clearly."""
    labels = np.repeat(truth, np.diff(docs.starts))
    total, positive = np.bincount(docs.features, minlength=FEATURES), np.bincount(docs.features, labels, FEATURES)
    return clear(total, positive, len(truth), truth.sum())


def fit_linear(docs: Documents, before: np.ndarray, truth: np.ndarray, cost: np.ndarray, seed: int = 3) -> Linear:
    """Logistic regression by adaptive gradient steps over mini-batches."""
    n, rng = len(truth), np.random.default_rng(seed)
    rate = np.clip(np.average(truth, weights=cost), 1e-3, 1 - 1e-3)
    model = Linear(np.zeros(FEATURES), np.zeros(before.shape[1]), float(np.log(rate / (1 - rate))))
    if truth.min() == truth.max():
        return model
    docs = docs.only(telling(docs, truth))
    seen, seen_earlier, seen_bias = np.full(FEATURES, 1e-8), np.full(before.shape[1], 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            chosen = order[start : start + BATCH]
            part = docs.rows(chosen)
            wrong = (model.predicted(part, before[chosen]) - truth[chosen]) * cost[chosen] / len(chosen)
            gradient = np.bincount(part.features, np.repeat(wrong, np.diff(part.starts)), FEATURES)
            used = np.flatnonzero(gradient)
            slope = gradient[used] + SHRINK * model.weights[used]
            seen[used] += slope * slope
            model.weights[used] -= RATE * slope / np.sqrt(seen[used])
            slope = before[chosen].T @ wrong
            seen_earlier += slope * slope
            model.earlier -= RATE * slope / np.sqrt(seen_earlier)
            slope = float(wrong.sum())
            seen_bias += slope * slope
            model.bias -= 0.1 * RATE * slope / np.sqrt(seen_bias)
    return model


@dataclass
class Chain:
    """Models of the categories in their order."""

    categories: list[str]
    models: list[Linear] = field(default_factory=list)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Documents x categories from the summed weights (documents x categories)."""
        out = np.zeros((len(sums), len(self.categories)))
        for k, model in enumerate(self.models):
            out[:, k] = _sigmoid(model.margins(sums[:, k], out[:, :k]))
        return out


def fit_chain(
    docs: Documents, categories: list[str], labels: np.ndarray, cost: np.ndarray, fold: np.ndarray | None = None
) -> Chain:
    """``labels``: documents x categories, NaN where unknown; ``fold``: of each document, in turn if not given."""
    chain, before = Chain(categories), np.zeros((len(labels), 0))
    fold = np.arange(len(labels)) % FOLDS if fold is None else fold
    for k in range(len(categories)):
        known = np.flatnonzero(~np.isnan(labels[:, k]))
        outside = np.zeros(len(labels))
        if not len(known):
            chain.models.append(Linear(np.zeros(FEATURES), np.zeros(k), -30.0))
        else:
            for f in range(FOLDS):
                seen, apart = known[fold[known] != f], np.flatnonzero(fold == f)
                if len(seen) and len(apart):
                    model = fit_linear(docs.rows(seen), before[seen], labels[seen, k], cost[seen])
                    outside[apart] = model.predicted(docs.rows(apart), before[apart])
            chain.models.append(fit_linear(docs.rows(known), before[known], labels[known, k], cost[known]))
        before = np.column_stack((before, outside))
    return chain


def labels_of(labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """doc_id and a 0 or 1 (null: unknown) for each category, y0, y1, …, one row for each id."""
    named = spelled(labels, [id_col, *(w for c in categories.values() for w in WORD.findall(c))])
    ys = [F.expr(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]
    known = named.select(F.col(named.columns[position(labels, id_col)]).cast("long").alias("doc_id"), *ys)
    known = known.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    return known.agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))])


def chosen_features(found: DataFrame, ys: list[str]) -> np.ndarray:
    """Marks of the features that are telling in some category, over all folds or over all but one.

    ``found``: fold, features and labels of each document. Features are counted where they
    lie; one row for each of at most ``FEATURES`` features is judged, and those chosen return.
    """
    sums = [(y, f) for y in ys for f in range(FOLDS)]
    here = lambda y, f: (F.col("fold") == f) & F.col(y).isNotNull()
    counts = [
        F.sum(F.when(here(y, f), value).otherwise(0)).alias(f"{name}_{y}_{f}")
        for y, f in sums for name, value in (("n", F.lit(1)), ("p", F.col(y)))
    ]
    all_of = {k: v or 0 for k, v in found.agg(*counts).first().asDict().items()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = np.zeros(batch.num_rows, bool)
            for y in ys:
                for apart in (None, *range(FOLDS)):
                    of = [f for f in range(FOLDS) if f != apart]
                    total, positive = (sum(batch.column(f"{x}_{y}_{f}").to_numpy() for f in of) for x in "np")
                    known, labelled = (sum(all_of[f"{x}_{y}_{f}"] for f in of) for x in "np")
                    chosen |= clear(total, positive, known, labelled)
            yield pa.RecordBatch.from_arrays([batch.column("feature").filter(pa.array(chosen))], ["feature"])

    each = found.select("fold", *ys, F.explode("features").alias("feature"))
    often = each.groupBy("feature").agg(F.count("*").alias("n"), *counts).where(F.col("n") >= LEAST_DOCUMENTS).drop("n")
    kept = np.zeros(FEATURES, bool)
    kept[often.mapInArrow(judge, "feature int").toArrow().column(0).to_numpy()] = True
    return kept


def fit(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
) -> Chain | None:
    """A chain fitted to the bounded sample; ``categories``: name to an SQL condition on ``labels``."""
    names = list(categories)
    ys = [f"y{k}" for k in range(len(names))]
    chosen, sizes = drawn(labels_of(labels, categories, id_col), ys, PER_GROUP)
    # broadcast: at most PER_GROUP ids of each of at most MAX_GROUPS + 1 groups
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sample = rows.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            words = [distinct_words(t) for t in texts]
            found = [sorted({f for w in ws for f in word_features(w)}) for ws in words]
            prints = [xxhash.xxh64_intdigest(t) >> 1 for t in texts]
            columns = [pa.array(prints, pa.int64()), pa.array([p % FOLDS for p in prints], pa.int32())]
            columns = [batch.column(0), *columns, pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "fold", "features", *ys])

    schema = "doc_id long, print long, fold int, features array<int>" + "".join(f", {y} int" for y in ys)
    found = sample.select("doc_id", "text", *ys).mapInArrow(features, schema).where("size(features) > 0")
    one = found.groupBy("doc_id").agg(*[F.min_by(c, "print").alias(c) for c in found.columns[2:]])
    found = written(one)
    kept = chosen_features(found, ys)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = [np.asarray(x, np.int64) for x in batch.column("features").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "fold", *ys)]
            lists = pa.array([x[kept[x]] for x in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "fold", *ys, "features"])

    schema = "doc_id long, fold int" + "".join(f", {y} int" for y in ys) + ", features array<int>"
    gathered = found.mapInArrow(narrowed, schema).toArrow()
    if not gathered.num_rows:
        return None
    gathered = gathered.sort_by([("doc_id", "ascending")]).combine_chunks()
    lists = gathered.column("features").combine_chunks()
    starts = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
    truth = np.column_stack([gathered.column(y).to_numpy(zero_copy_only=False).astype(float) for y in ys])
    combos = list(zip(*(gathered.column(y).to_pylist() for y in ys)))
    groups = [c if c in sizes else () for c in combos]
    in_sample = Counter(groups)
    cost = np.array([np.sqrt(sizes[g]) / in_sample[g] for g in groups])
    fold = gathered.column("fold").to_numpy()
    return fit_chain(Documents(lists.flatten().to_numpy(), starts), names, truth, cost / cost.mean(), fold)


class Scorer:
    """Probabilities of texts; what a word weighs in each model is remembered."""

    def __init__(self, chain: Chain | None, categories: int):
        self.chain, self.categories = chain, categories
        self.at: dict[str, int] = {}
        if chain:
            self.by_feature = np.column_stack([m.weights for m in chain.models])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.categories))
        words = [distinct_words(t) for t in texts]
        full = [k for k, w in enumerate(words) if w]
        if not self.chain or not full:
            return out
        if len(self.at) > CACHE_CHUNKS or not self.at:
            self.at, self.rows = {}, np.zeros((0, self.categories))
        new = sorted(set().union(*words).difference(self.at))
        if new:
            features = [word_features(w) for w in new]
            starts = np.cumsum([0, *(len(f) for f in features[:-1])])
            summed = np.add.reduceat(self.by_feature[np.concatenate(features)], starts, axis=0)
            self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate((self.rows, summed))
        sizes = np.array([len(words[k]) for k in full])
        at = np.fromiter((self.at[w] for k in full for w in words[k]), np.int64, int(sizes.sum()))
        sums = np.add.reduceat(self.rows[at], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        out[full] = self.chain.probabilities(sums)
        return out


def _scored(docs: DataFrame, chain: Chain | None, categories: list[str], text_col: str) -> DataFrame:
    def make() -> Callable:
        scorer = Scorer(chain, len(categories))
        return lambda texts: [pa.array(column, pa.float64()) for column in scorer(texts).T]

    return annotated(docs, text_col, make, [(f"p_{name}", "double") for name in categories])


def classify(
    docs: DataFrame, chain: Chain | None, categories: list[str], reject: str = "toxic", threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, a probability for each category, and whether the document is rejected."""
    out = _scored(narrow(docs, doc_id=id_col, text=text_col), chain, categories, "text")
    probabilities = [F.col(f"p_{name}") for name in categories]
    return out.select(F.col("c0").alias("doc_id"), *probabilities, (F.col(f"p_{reject}") >= threshold).alias(reject))


def keep_clean(
    docs: DataFrame, chain: Chain | None, categories: list[str], reject: str = "toxic", threshold: float = 0.5,
    text_col: str = "text",
) -> DataFrame:
    """Documents that are not rejected, with all their columns."""
    return restored(_scored(docs, chain, categories, text_col).where(F.col(f"p_{reject}") < threshold), docs)
