"""Periodic runs of words inside a document, found by seeds on diagonals.

A run of smallest period q and at least 4q words matches itself at lag q over at least
3q words, five for q = 1.  For the lags of one octave, [2^j, 2^(j+1)), every run thus
holds two occurrences, q apart, of a gram of max(5, 3 * 2^j) words, the smallest overlap
that is guaranteed.  Such a gram is at least q long, so no occurrence lies between the
two (else the run would have a smaller period), and pairs of neighbouring occurrences
are all that is needed: their number is linear in the words, never a square.

Grams are named exactly, by doubling: the name of 2^(j+1) words is the pair of names of
its halves, and positions whose name does not come back in their document drop out at
once.  A pair is extended along its diagonal until the words differ; the furthest word
covered per lag suppresses seeds that lie in a stretch already extended.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from gleaner.llm.common import bounded_batches

# A run has at least so many words, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# The shortest guaranteed overlap: a run of period 1 has 6 words, 5 of which match the next.
SHORTEST = LEAST_WORDS - 1
# Words compared at once when a seed is extended; each further step takes four times as many.
STRIDE = 64

SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small number for every key, equal for equal keys, and whether the key comes twice."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.cumsum(first) - 1
    names, twice = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    names[order] = rank
    twice[order] = np.bincount(rank)[rank] > 1
    return names, twice


class _Grams:
    """Positions whose gram comes back in its document, in order, and the names of those grams."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, size: int):
        names, twice = _names(keys) if len(keys) else (keys, np.zeros(0, bool))
        self.at, self.own = at[twice], names[twice]
        self.names = np.full(size, -1, np.int64)
        self.names[self.at] = self.own

    def joined(self, other: _Grams, shift: int) -> _Grams:
        """Grams of this one and the other one ``shift`` words on."""
        size = len(self.names)
        inside = self.at + shift < size
        at, own = self.at[inside], self.own[inside]
        right = other.names[at + shift]
        both = right >= 0
        return _Grams(at[both], own[both] * size + right[both], size)

    def neighbours(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(lag, position) of neighbouring occurrences with low <= lag < high, ordered."""
        order = np.argsort(self.own, kind="stable")
        at, own = self.at[order], self.own[order]
        lag = at[1:] - at[:-1]
        seed = (own[1:] == own[:-1]) & (lag >= low) & (lag < high)
        lag, at = lag[seed], at[:-1][seed]
        order = np.lexsort((at, lag))
        return lag[order], at[order]


def _last_match(words: np.ndarray, i: int, lag: int) -> int:
    """The first place from ``i`` on whose word differs from the one ``lag`` on."""
    end, step = len(words) - lag, STRIDE
    while i < end:
        j = min(i + step, end)
        differ = words[i:j] != words[i + lag : j + lag]
        if differ.any():
            return i + int(differ.argmax())
        i, step = j, 4 * step
    return end


def _first_match(words: np.ndarray, i: int, lag: int) -> int:
    """The first of the places before ``i`` that match the word ``lag`` on without a break."""
    step = STRIDE
    while i > 0:
        j = max(i - step, 0)
        differ = words[j:i] != words[j + lag : i + lag]
        if differ.any():
            return i - int(differ[::-1].argmax())
        i, step = j, 4 * step
    return 0


def _extended(words: np.ndarray, lags: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal stretches (start, length, period) around the seeds."""
    again = np.zeros(len(lags), bool)
    again[1:] = (lags[1:] == lags[:-1]) & (places[1:] == places[:-1] + 1)
    covered: dict[int, int] = {}
    for lag, at in zip(lags[~again].tolist(), places[~again].tolist(), strict=True):
        if at < covered.get(lag, 0):
            continue
        end = _last_match(words, at, lag)
        covered[lag] = end
        start = _first_match(words, at, lag)
        length = end + lag - start
        if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
            yield start, length, lag


def runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``words`` numbers the words of all documents one after the other, ``sizes`` counts
    the words of each.
    """
    total = len(words)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keys = doc * (int(words.max(initial=0)) + 1) + words
    found: list[tuple[int, int, int]] = []
    one = _Grams(np.arange(total), keys, total)
    two = one.joined(one, 1)
    four = two.joined(two, 2)
    found += _extended(keys, *four.joined(one, 4).neighbours(1, 2))
    half, whole, octave = two, four, 2
    while len(whole.at):
        found += _extended(keys, *whole.joined(half, 2 * octave).neighbours(octave, 2 * octave))
        half, whole, octave = whole, whole.joined(whole, 2 * octave), 2 * octave
    rows = np.array(found, np.int64).reshape(-1, 3)
    at = doc[rows[:, 0]]
    rows[:, 0] -= (np.cumsum(sizes) - sizes)[at]
    rows = np.column_stack([at, rows])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without what follows the first period of each run."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _found(texts: list[str | None]) -> pa.StructArray:
    cut = [(text or "").encode("utf-8", "replace").split() for text in texts]
    sizes = np.array([len(own) for own in cut], np.int64)
    numbers = {word: i for i, word in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
    words = np.fromiter(map(numbers.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
    rows = runs_of(words, sizes)
    bounds = np.searchsorted(rows[:, 0], np.arange(len(cut) + 1))
    collapsed = [
        _collapsed(own, rows[i:j, 1:]) if i < j else b" ".join(own)
        for own, i, j in zip(cut, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
    ]
    runs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [
            pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
            pa.array([text.decode() for text in collapsed], pa.string()),
        ],
        names=["n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, text_col: str = "text", out_col: str = "periodic") -> DataFrame:
    """``docs`` with a struct ``out_col``: n_words, runs (start, length, period), collapsed.

    Words are separated by ASCII white space.  ``runs`` holds every run, by start and
    then period; ``collapsed`` the words, joined by one space, without those that some
    run holds after its first period.  Null and empty texts have no words, no runs and
    an empty ``collapsed``.  Each row stands alone: repeated rows get equal results, no
    rows give no rows, and a text of any length is one row's work, linear in its words
    but for the sort.  A column named like ``out_col`` is replaced; pass another name.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != out_col]
    place = names.index(text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _found(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, out_col])

    rows = docs.select(*names)
    return rows.mapInArrow(find, StructType([*rows.schema.fields, StructField(out_col, StructType.fromDDL(SCHEMA))]))
