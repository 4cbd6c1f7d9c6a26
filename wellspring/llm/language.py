"""Language of texts by a bidirectional gated recurrent network over bytes.

Texts are lower-cased; what belongs to no letter (marks of letters do) becomes a blank symbol. The whole
text is read in windows of ``WINDOW`` bytes. A gated recurrent layer reads each window
forwards and another backwards; from both states every position gets a probability for
each language, and the document's probabilities are their mean over letter positions. The
network is trained in numpy by backpropagation through time, on a sample of at most
``PER_LANGUAGE`` documents of each language and ``WINDOWS`` windows of each, drawn by a hash.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0; so is
every text if there is nothing to learn from; a single learned language has score 1;
documents without language or id are not learned from; rows that repeat are labelled
each; an empty table stays empty; ties go to the first language in order; other columns
are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import annotated, drawn, narrow, restored, slices

WINDOW, HIDDEN = 96, 8
#: Bounds of the training sample: documents of a language, windows of a document.
PER_LANGUAGE, WINDOWS = 400, 6
STEPS, BATCH, RATE = 500, 256, 0.02
#: Windows that go through the network at a time.
WIDE = 4096
UNKNOWN = "und"

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


@functools.lru_cache(1 << 16)
def _letters(run: str) -> str:
    """A run of characters beyond ASCII with a space for each that is no letter and no mark."""
    return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in run)


def windows_of(text: str) -> np.ndarray:
    """Symbols of the whole text, one row for each window, filled up with blanks."""
    text = text.lower()
    if not text.isascii():
        text = _BEYOND_ASCII.sub(lambda run: _letters(run[0]), text)
    symbols = _SYMBOL[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    rows = -(-len(symbols) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(symbols)] = symbols
    return out.reshape(rows, WINDOW)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _layer(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """inputs: update and reset gates and candidate for each symbol, biases included."""
    h = HIDDEN
    return {
        "inputs": rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32),
        "gates": rng.normal(0, 0.4, (2 * h, h)).astype(np.float32),
        "candidate": rng.normal(0, 0.4, (h, h)).astype(np.float32),
    }


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= 0.5
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


@dataclass
class Network:
    """Two layers, and the output weights over their joined states."""

    languages: list[str]
    layers: list[dict[str, np.ndarray]]  # forwards, backwards
    output: np.ndarray  # languages x (2 HIDDEN + 1), the last column a bias

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        output = rng.normal(0, 0.3, (len(languages), 2 * HIDDEN + 1)).astype(np.float32)
        return cls(languages, [_layer(rng), _layer(rng)], output)

    def _states(self, layer: dict[str, np.ndarray], steps: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States after each step (steps x HIDDEN x windows); ``kept`` gets what training needs."""
        h, wide = HIDDEN, steps.shape[1]
        states = np.empty((len(steps), h, wide), np.float32)
        state = np.zeros((h, wide), np.float32)
        for t, symbols in enumerate(steps):
            given = layer["inputs"].take(symbols, axis=1)
            gates = layer["gates"] @ state
            gates += given[: 2 * h]
            gates = _sigmoid(gates)
            update, reset = gates[:h], gates[h:]
            candidate = layer["candidate"] @ (reset * state)
            candidate += given[2 * h :]
            np.tanh(candidate, out=candidate)
            if kept is not None:
                kept.append((state, update, reset, candidate))
            state = np.add(state, update * (candidate - state), out=states[t])
        return states

    def _positions(self, forwards: np.ndarray, backwards: np.ndarray) -> np.ndarray:
        """Probabilities: languages x windows, of one position."""
        logits = self.output[:, :HIDDEN] @ forwards
        logits += self.output[:, HIDDEN:-1] @ backwards
        logits += self.output[:, -1:]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the probabilities over each window's letters, and the number of letters."""
        total = np.zeros((len(self.languages), len(windows)), np.float32)
        for start in range(0, len(windows), WIDE):
            steps = np.ascontiguousarray(windows[start : start + WIDE].T)
            ahead = self._states(self.layers[0], steps)
            back = self._states(self.layers[1], steps[::-1])[::-1]
            part = total[:, start : start + WIDE]
            for t, symbols in enumerate(steps):
                part += self._positions(ahead[t], back[t]) * (symbols != 0)
        return total, (windows != 0).sum(axis=1)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over letter positions and its gradients, in the order of ``weights``."""
        steps = np.ascontiguousarray(windows.T)
        kept: list[list] = [[], []]
        ahead = self._states(self.layers[0], steps, kept[0])
        back = self._states(self.layers[1], steps[::-1], kept[1])[::-1]
        truth = np.zeros((len(self.languages), len(labels)), np.float32)
        truth[labels, np.arange(len(labels))] = 1
        letters = max(1, int((steps != 0).sum()))
        loss, output = 0.0, np.zeros_like(self.output)
        d_ahead, d_back = np.empty_like(ahead), np.empty_like(ahead)
        for t, symbols in enumerate(steps):
            probability, counts = self._positions(ahead[t], back[t]), (symbols != 0).astype(np.float32)
            loss -= float((np.log((probability * truth).sum(axis=0) + 1e-12) * counts).sum())
            wrong = (probability - truth) * (counts / letters)
            output[:, :HIDDEN] += wrong @ ahead[t].T
            output[:, HIDDEN:-1] += wrong @ back[t].T
            output[:, -1] += wrong.sum(axis=1)
            d_ahead[t], d_back[t] = self.output[:, :HIDDEN].T @ wrong, self.output[:, HIDDEN:-1].T @ wrong
        first = self._through_time(self.layers[0], steps, kept[0], d_ahead)
        second = self._through_time(self.layers[1], steps[::-1], kept[1], d_back[::-1])
        return loss / letters, [*first, *second, output]

    def _through_time(self, layer: dict, steps: np.ndarray, kept: list, given: np.ndarray) -> list[np.ndarray]:
        h, wide = HIDDEN, steps.shape[1]
        gates, candidate = np.zeros_like(layer["gates"]), np.zeros_like(layer["candidate"])
        flows = np.empty((3 * h, len(steps), wide), np.float32)
        later = np.zeros((h, wide), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            state, update, reset, new = kept[t]
            flow = given[t] + later
            d_new = flow * update * (1 - new * new)
            d_mixed = layer["candidate"].T @ d_new
            d_gates = np.concatenate(
                (flow * (new - state) * update * (1 - update), d_mixed * state * reset * (1 - reset))
            )
            candidate += d_new @ (reset * state).T
            gates += d_gates @ state.T
            later = flow * (1 - update) + d_mixed * reset + layer["gates"].T @ d_gates
            flows[: 2 * h, t], flows[2 * h :, t] = d_gates, d_new
        symbols = steps.ravel()
        inputs = np.stack([np.bincount(symbols, row.ravel(), 256) for row in flows]).astype(np.float32)
        return [inputs, gates, candidate]

    @property
    def weights(self) -> list[np.ndarray]:
        return [w for layer in self.layers for w in layer.values()] + [self.output]


def trained(languages: list[str], windows: np.ndarray, labels: np.ndarray, seed: int = 5) -> Network:
    """A network fitted to labelled windows, each language equally often, by Adam."""
    network, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    of_language = [np.flatnonzero(labels == k) for k in range(len(languages))]
    mean = [np.zeros_like(w) for w in network.weights]
    square = [np.zeros_like(w) for w in network.weights]
    for step in range(1, STEPS + 1):
        drawn = np.concatenate([rng.choice(rows, -(-BATCH // len(languages))) for rows in of_language])
        _, gradients = network.gradients(windows[drawn], labels[drawn])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for weight, m, v, g in zip(network.weights, mean, square, gradients):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on the bounded sample; None if no document has language and letters."""
    rows = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0))
    ranked, _ = drawn(usable, ["lang"], PER_LANGUAGE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                rows = windows_of(text)
                at = np.unique(np.linspace(0, len(rows) - 1, WINDOWS).astype(int)) if len(rows) else []
                found += [(lang, str(doc_id), int(k), rows[k].tobytes()) for k in at if rows[k].any()]
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(("lang", "doc_id", "k", "window"), f)) for f in found])

    sample = ranked.select("doc_id", "text", "lang").mapInArrow(cut, "lang string, doc_id string, k long, window binary")
    # at most PER_LANGUAGE x WINDOWS rows of WINDOW bytes for each language
    found = sorted(tuple(r) for r in sample.collect())
    if not found:
        return None
    languages = sorted({f[0] for f in found})
    windows = np.frombuffer(b"".join(bytes(f[3]) for f in found), np.uint8).reshape(-1, WINDOW)
    return trained(languages, windows, np.array([languages.index(f[0]) for f in found]))


def labeller(network: Network | None) -> Callable[[list[str | None]], tuple[list[str], list[float]]]:
    """A function from texts to their languages and scores."""

    def label(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, text in enumerate(texts) if network and has_letter(text)]
        cut = [windows_of(texts[k]) for k in known]
        if not cut:
            return names, scores
        total, letters = network.pooled(np.concatenate(cut))
        starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
        total = np.add.reduceat(total.astype(np.float64), starts, axis=1)
        letters = np.add.reduceat(letters, starts)
        for n, k in enumerate(known):
            if letters[n]:
                share = total[:, n] / letters[n]
                best = int(share.argmax())
                names[k], scores[k] = network.languages[best], float(min(1.0, share[best]))
        return names, scores

    return label


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    rows = narrow(docs, doc_id=id_col, text=text_col)

    def make() -> Callable:
        label = labeller(network)

        def work(texts: list[str | None]) -> list[pa.Array]:
            names, scores = label(texts)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    out = annotated(rows, "text", make, [("lang_pred", "string"), ("score", "double")])
    held_out = F.coalesce(remainder(F.col("c0")) == 0, F.lit(False))
    return out.select(F.col("c0").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def keep_recognised(
    docs: DataFrame, network: Network | None, least_score: float = 0.4, text_col: str = "text"
) -> DataFrame:
    """Documents with a recognised language, all their columns: not ``und``, and a clear score.

    Without a network no language is known to reject a document by: all texts with a letter stay.
    """

    def make() -> Callable:
        label = labeller(network)

        def work(texts: list[str | None]) -> list[pa.Array]:
            if not network:
                return [pa.array(map(has_letter, texts), pa.bool_())]
            names, scores = label(texts)
            return [pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores)], pa.bool_())]

        return work

    return restored(annotated(docs, text_col, make, [("recognised", "boolean")]).where("recognised"), docs)
