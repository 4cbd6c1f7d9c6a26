"""Runs of periodic word sequences, found by minimizers at several scales.

A run is a longest stretch of words whose smallest period q fits at least four times (and
that has at least ``LEAST`` words): words q apart are equal, and no neighbour extends it.

* Periods up to ``SHORT`` are too short for windows: each is scanned directly, words against
  words q places on.
* Scale s covers periods from w = 2**s below 2w. Each sequence of 2w words (a gram) is hashed, and in
  every window of w grams the leftmost least hash is kept. Two windows q apart in a run hold
  the same grams, so their minima are equal and lie q apart; a gram is no shorter than the
  period, so it does not recur in between. Both windows together span fewer than 4q words:
  every run shows at least one pair of consecutive equal minima at a distance of its period.
* Such a pair seeds the stretch of that lag: words are compared in both directions until they
  differ. Seeds inside a stretch already found are passed over, so the work is bounded by the
  length of what is found.

A stretch that has a smaller period is found under that too, with the same ends; the smallest
period stays. Work and memory grow with a text's length, whatever it repeats. Hashes only
propose: every stretch is compared word by word. Hashes have 64 bits; a run would be
overlooked only if an unlike gram of equal hash stood within each of its pairs.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a text
without runs collapses to its words joined by one space; rows that repeat are handled each;
an empty table stays empty; other columns are kept in their places, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wellspring.llm.common import annotated

#: Words of the shortest run, and how often its period has to fit.
LEAST, TIMES = 6, 4
#: Periods that are scanned directly.
SHORT = 15
#: Texts that are laid end to end have about so many characters together.
CHARACTERS = 1_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the leftmost least hash of some window of ``width``, a power of two."""
    at, span = np.arange(len(hashes)), 1
    while span < width:
        left, right = at[:-span], at[span:]
        at = np.where(hashes[left] <= hashes[right], left, right)
        span *= 2
    return at[np.flatnonzero(np.diff(at, prepend=-1))]  # leftmost minima never move back


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of both are equal."""
    n, done, step = min(len(a), len(b)), 0, 64
    a, b = a[:n], b[:n]
    while done < n:
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, 2 * step
    return n


def _short_stretches(words: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    for lag in range(1, min(SHORT, len(words) - 1) + 1):
        equal = np.zeros(len(words) - lag + 2, np.int8)
        equal[1:-1] = words[:-lag] == words[lag:]
        edges = np.flatnonzero(np.diff(equal))
        starts, ends = edges[::2], edges[1::2] + lag
        long = ends - starts >= max(LEAST, TIMES * lag)
        found += [(s, e, lag) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return found


def _seeds(hashes: np.ndarray, width: int) -> np.ndarray:
    """(lag, place) of consecutive equal minimizers whose distance is of this scale, sorted."""
    places = _minimizers(hashes, width)
    places = places[np.argsort(hashes[places], kind="stable")]
    lags = np.diff(places)
    fits = (hashes[places[1:]] == hashes[places[:-1]]) & (lags >= width) & (lags < 2 * width)
    pairs = np.stack([lags[fits], places[:-1][fits]], axis=1)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _long_stretches(words: np.ndarray, text_of: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    at, hashes, gram = np.arange(len(words)), _mixed(words.view(np.uint64) + np.uint64(1)), 1
    width = SHORT + 1
    while True:
        # texts too short for a run of this scale take no further part
        kept = lengths[text_of[at]] >= TIMES * width
        at = at[: len(hashes)][kept[: len(hashes)]]
        hashes = hashes[kept[: len(hashes)]]
        while gram < 2 * width and len(hashes) > gram:
            hashes = _mixed(hashes[:-gram] * np.uint64(0x9E3779B97F4A7C15) + hashes[gram:])
            gram *= 2
        if gram < 2 * width or len(hashes) < width:
            return found
        last = (0, 0, 0)
        for lag, place in _seeds(hashes, width).tolist():
            start = int(at[place])
            if lag == last[2] and last[0] <= start and start + lag < last[1]:
                continue
            right = _agreeing(words[start:], words[start + lag :])
            left = _agreeing(words[:start][::-1], words[: start + lag][::-1][: start]) if right else 0
            last = (start - left, start + right + lag, lag)
            if last[1] - last[0] >= TIMES * lag:
                found.append(last)
        width *= 2


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each sequence of word numbers, by start and period.

    Sequences are laid end to end with a number of its own after each, which no lag can cross.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    words = np.empty(begins[-1], np.int64)
    for begin, text, k in zip(begins.tolist(), texts, range(len(texts))):
        words[begin : begin + len(text)] = text
        words[begin + len(text)] = -1 - k
    smallest: dict[tuple[int, int], int] = {}
    text_of = np.repeat(np.arange(len(texts)), lengths + 1)
    for start, end, lag in _short_stretches(words) + _long_stretches(words, text_of, lengths):
        smallest[start, end] = min(lag, smallest.get((start, end), lag))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, end), lag in smallest.items():
        k = int(text_of[start])
        runs[k].append((start - int(begins[k]), end - start, lag))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when every run is cut down to its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def _some_at_a_time(texts: list[str | None]) -> Iterator[list[str]]:
    """Consecutive texts of together about ``CHARACTERS``, or one that is longer by itself."""
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= CHARACTERS:
            yield some
            some, size = [], 0
    yield some


def _analysed(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Number of words, runs and collapsed text of each text."""
    split = [t.encode().split() for t in texts]  # at ASCII white space alone
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in split]
    for words, runs in zip(split, find_runs(coded)):
        kept = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))] if runs else words
        yield len(words), runs, b" ".join(kept).decode()


def _work() -> Callable[[list[str | None]], list[pa.Array]]:
    def work(texts: list[str | None]) -> list[pa.Array]:
        found = [row for some in _some_at_a_time(texts) for row in _analysed(some)]
        runs = [[dict(zip(("start", "length", "period"), r)) for r in row[1]] for row in found]
        return [
            pa.array([row[0] for row in found], pa.int64()),
            pa.array(runs, _RUN_TYPE),
            pa.array([row[2] for row in found], pa.string()),
        ]

    return work


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns by place (c0, c1, …), then n_words, runs and the collapsed text."""
    return annotated(docs, text_col, _work, [("n_words", "bigint"), ("runs", RUNS), ("collapsed", "string")])


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with runs cut down to their first period."""
    found = detect(docs, text_col)
    at = [i for i, n in enumerate(docs.columns) if n == text_col] or [
        i for i, n in enumerate(docs.columns) if n.lower() == text_col.lower()
    ]
    columns = [found["collapsed"] if i == at[0] else found[f"c{i}"] for i in range(len(docs.columns))]
    return found.select(*columns).toDF(*docs.columns)
