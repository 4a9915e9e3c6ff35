"""Periodic runs of words: stretches that repeat a block of words at least four times.

An online diagonal DP over the words of a text. For each word, its earlier occurrences extend the match lengths of their
lags; a diagonal that is not extended ends, and is reported at once if it is long enough. To keep the occurrences sparse
a word is known by the words that follow it: for lags from g/2 to g-1, by the g-gram that starts there, with g a power of
two. A run of period q with at least 4 q words contains every such g-gram at distance q, and the nearest earlier
occurrence of the g-gram is then exactly q away: were it nearer, both distances would be periods of a stretch at least as
long as their sum, so their common divisor would be a period too, and q not the smallest. One earlier occurrence for each
word and level is therefore enough, no pairs of a frequent word are formed, and multiples of a period never appear.
g-grams are named by doubling, exactly and without hashing; one that occurs once is left out of all longer ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from peakloom.llm.common import whole_text

MIN_WORDS = 6
MIN_EXPONENT = 4
#: Words of the texts that are looked at together; a longer text stands alone.
TOGETHER = 100_000

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def near_occurrences(words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(g, places, lags): where the nearest earlier occurrence of the g-gram is at least g/2 and less than g away."""
    n = len(words)
    names, alive = words.astype(np.int64) + 1, np.arange(n)
    size = 1
    # a run has at least four periods, so no lag is over a quarter of the text
    while 4 * size <= longest and len(alive):
        alive = alive[alive + size < n]
        alive = alive[names[alive + size] > 0]
        keys = names[alive] * np.int64(n + 2) + names[alive + size]
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], alive[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)
        lags = np.diff(places, prepend=0)
        size *= 2
        near = np.flatnonzero(~new & (lags >= size // 2) & (lags < size))
        yield size, places[near], lags[near]
        names = np.zeros(n, np.int64)
        names[places[~alone]] = group[~alone]
        alive = np.sort(places[~alone])


def diagonals(hits: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the diagonals that last long enough, as they end. Hits: (place, lag, g) by place."""
    before: dict[tuple[int, int], int] = {}
    growing: dict[tuple[int, int], int] = {}
    here = -2

    def ended(diagonals: dict[tuple[int, int], int], last: int) -> Iterator[tuple[int, int, int]]:
        for (lag, g), first in diagonals.items():
            length = last - first + g + lag
            if length >= max(MIN_WORDS, MIN_EXPONENT * lag):
                yield first - lag, length, lag

    for place, lag, g in hits:
        if place != here:
            yield from ended(before, here - 1)
            before, growing = growing, {}
            if place != here + 1:
                yield from ended(before, here)
                before = {}
            here = place
        growing[lag, g] = before.pop((lag, g), place)
    yield from ended(before, here - 1)
    yield from ended(growing, here)


def runs_of(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers below its length, by start and period."""
    found = list(near_occurrences(words, len(words) if longest is None else longest))
    if not found:
        return []
    places = np.concatenate([p for _, p, _ in found])
    lags = np.concatenate([x for _, _, x in found])
    sizes = np.repeat([g for g, _, _ in found], [len(p) for _, p, _ in found])
    order = np.argsort(places, kind="stable")
    hits = zip(places[order].tolist(), lags[order].tolist(), sizes[order].tolist())
    return sorted(diagonals(hits), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts. No two texts share a word number, so no gram occurs in two of them."""
    numbers: list[int] = []
    starts = [0]
    for words in texts:
        known: dict[bytes, int] = {}
        first = starts[-1]
        numbers.extend([known.setdefault(w, first + len(known)) for w in words])
        starts.append(len(numbers))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = runs_of(np.array(numbers, np.int64), max((len(w) for w in texts), default=0))
    if found:
        which = np.searchsorted(starts, [r[0] for r in found], "right") - 1
        for text, (start, length, period) in zip(which.tolist(), found):
            out[text].append((start - starts[text], length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def find_runs(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per input row: the id, n_words, runs (by start, then period; words numbered from 0) and collapsed.

    Words end at the six white space characters of ASCII. Null text counts as empty; a text without words has no runs and
    the collapsed text ''. Any text is looked at as a whole, in one task. Equal rows get equal results, null ids too; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, held, size = batch.column(0), 0, [], 0
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                words = text.as_py().split()
                held.append(words)
                size += len(words)
                if size >= TOGETHER or row == len(batch) - 1:
                    runs = runs_of_texts(held)
                    columns = [
                        ids[first : row + 1], pa.array([len(w) for w in held], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], listed),
                        pa.array([collapsed(w, r) for w, r in zip(held, runs)], pa.binary()).cast(pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    first, held, size = row + 1, [], 0

    listed = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    names = [id_column, "n_words", "runs", "collapsed"]
    kind = df.schema[id_column]
    shape = T.StructType([
        kind, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())
    ])
    return df.select(f"`{id_column}`", whole_text().alias("_text")).mapInArrow(run, shape)
