"""Ordinal quality classifier: a cumulative-link regression on hashed text features.

One weight per feature bucket is shared by all grades; ordered thresholds cut the score into grades:
P(grade >= j) = logistic(score - threshold[j]). The expected grade and the probability of the top grade follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from peakloom.llm.common import fresh
from peakloom.llm.vector import BYTE_VALUE, mix, pieces, prefix_sums, run_hashes, runs

BITS = 18
#: Lengths in bytes of the word beginnings that count as features beside the whole word.
STEMS = (4, 5)

# Kinds of bytes: 1 letters (all of UTF-8 beyond ASCII too), 2 digits, 3 other signs, 0 white space.
_kind = np.full(256, 3, np.uint8)
_kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_kind[0x30:0x3A] = 2
_kind[0x41:0x5B] = _kind[0x61:0x7B] = _kind[0x80:] = 1
_folded = BYTE_VALUE.copy()
_folded[0x41:0x5B] = BYTE_VALUE[0x61:0x7B]
SHAPES = 8  # document-level features, ten steps each


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of every text: (texts, buckets), sorted by text.

    Features are runs of letters (case folded) and their beginnings, runs of digits and of signs, present or not, and steps
    of text shape: length,
    shares of capitals, signs and digits, share of distinct words, of line breaks, mean word length.
    """
    n = len(offsets) - 1
    kind = _kind[data]
    starts, stops = runs(kind, offsets)
    sums = prefix_sums(data, _folded)
    owner = np.searchsorted(offsets, starts, "right") - 1
    buckets = (run_hashes(sums, starts, stops) >> np.uint64(64 - BITS)).astype(np.int64)
    letters = kind[starts] == 1
    stems = []
    for length in STEMS:
        longer = letters & (stops - starts > length)
        # another constant for each length: a stem is not the word that is spelled like it
        h = mix(run_hashes(sums, starts[longer], starts[longer] + length) + np.uint64(length))
        stems.append(owner[longer].astype(np.int64) << 20 | (h >> np.uint64(64 - BITS)).astype(np.int64))

    sizes = np.maximum(np.diff(offsets), 1).astype(float)
    words = np.bincount(owner[letters], minlength=n).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / sizes

    pairs = np.unique(owner[letters].astype(np.int64) << BITS | buckets[letters])
    distinct = np.bincount(pairs >> BITS, minlength=n) / np.maximum(words, 1)
    letter_bytes = np.bincount(owner[letters], (stops - starts)[letters], minlength=n)
    upper = share((data >= 0x41) & (data <= 0x5A)) * sizes / np.maximum(letter_bytes, 1)
    shape = np.stack([
        np.log2(words + 1) / 1.6, upper * 10, share(kind == 3) * 25, share(kind == 2) * 25,
        distinct * 10, share(data == 0x0A) * 100, letter_bytes / np.maximum(words, 1), share(kind == 0) * 20,
    ], axis=1)
    steps = np.clip(shape, 0, 9).astype(np.int64)
    own = (1 << BITS) + np.arange(SHAPES) * 10 + steps
    every = np.unique(np.concatenate([
        owner.astype(np.int64) << 20 | buckets, *stems, (np.arange(n, dtype=np.int64)[:, None] << 20 | own).ravel(),
    ]))
    return every >> 20, every & ((1 << 20) - 1)


WIDTH = (1 << BITS) + SHAPES * 10


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(texts, self.weights[buckets], minlength=n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ...: one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def fit(
    texts: np.ndarray, buckets: np.ndarray, grades: np.ndarray, steps: int = 200, min_texts: int = 6, sparsity: float = 3e-4
) -> OrdinalModel:
    """Maximum likelihood by full-batch Adam steps with a proximal L1 penalty; features in fewer than ``min_texts`` texts
    are left out. The penalty sets the weights of neutral words to zero, so that a long text does not gather noise.
    Thresholds stay ordered because their gaps are exponentials. Rare grades weigh more, by the root of their share.
    """
    n, top = len(grades), max(int(grades.max(initial=0)), 1)
    known = (np.bincount(buckets, minlength=WIDTH) >= min_texts)[buckets]
    texts, columns = texts[known], buckets[known]
    used, buckets = np.unique(columns, return_inverse=True)
    rows, width = np.arange(n), len(used)
    share = np.sqrt(n / np.maximum(np.bincount(grades, minlength=top + 1), 1) / (top + 1))[grades]
    above, below = grades >= 1, grades < top
    w, cut = np.zeros(width), np.concatenate([[-1.0], np.zeros(top - 1)])
    moments = [np.zeros(width), np.zeros(width), np.zeros(top), np.zeros(top)]
    for step in range(1, steps + 1):
        gaps = np.exp(cut[1:])
        model = OrdinalModel(w, cut[0] + np.concatenate([[0], np.cumsum(gaps)]))
        full = np.concatenate([np.ones((n, 1)), model.tails(model.scores(texts, buckets, n)), np.zeros((n, 1))], axis=1)
        high, low = full[rows, grades], full[rows, grades + 1]
        pull_high, pull_low = (share * x * (1 - x) / np.maximum(high - low, 1e-9) / n for x in (high, low))
        by_threshold = np.bincount(grades[above] - 1, pull_high[above], minlength=top)
        by_threshold = by_threshold - np.bincount(grades[below], pull_low[below], minlength=top)
        by_cut = np.concatenate([[by_threshold.sum()], np.cumsum(by_threshold[::-1])[::-1][1:] * gaps])
        by_weight = np.bincount(buckets, (pull_low - pull_high)[texts], minlength=width)
        rate = 0.05 * (1 - step / (steps + 1))
        for k, (value, slope) in enumerate(((w, by_weight), (cut, by_cut))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            value -= scale * m / (1 - 0.9**step)
            if k == 0:
                value[:] = np.sign(value) * np.maximum(np.abs(value) - scale * sparsity, 0)
    weights = np.zeros(WIDTH)
    weights[used] = w
    return OrdinalModel(weights, cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))]))


def training_rows(df: DataFrame, ratings: DataFrame, max_rows: int = 8000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and grades of at most ``max_rows`` rated documents, chosen by a hash of doc_id. Ratings are one per doc_id:
    (doc_id, grade); the bound keeps the driver's share the same for any corpus."""
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # of several rows with one doc_id, one is taken
    found = F.broadcast(chosen).join(df.select("doc_id", "text"), "doc_id")
    rows = found.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                texts, buckets = features(data, offsets)
                bounds = np.searchsorted(texts, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), lists], ["doc_id", "grade", "f"])

    table = rows.mapInArrow(extract, T.StructType([rows.schema["doc_id"], rows.schema["grade"], T.StructField("f", T.ArrayType(T.IntegerType()))])).toArrow()
    table = table.combine_chunks()
    sizes = np.array([len(x) for x in table.column("f")], np.int64) if table.num_rows else np.zeros(0, np.int64)
    order = table.column("f").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    values = order.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), values, np.array(table.column("grade").to_pylist(), np.int64)


def classify(df: DataFrame, ratings: DataFrame, accept: float = 0.5, max_rows: int = 8000) -> DataFrame:
    """All columns of ``df`` plus expected_grade, tail (probability of the top grade) and accepted (tail >= ``accept``).

    ``ratings`` has (doc_id, grade), grades 0, 1, ...; the model is fitted on at most ``max_rows`` of them. Null text
    counts as empty and is scored by its shape like any other. Without any rating there is nothing to judge by: every
    row is accepted and both numbers are null. Equal texts get equal results; an empty table gives no rows; columns of
    ``df`` with the names of the results are replaced.
    """
    texts, buckets, grades = training_rows(df, ratings, max_rows)
    names = [c for c in df.columns if c.lower() not in ("expected_grade", "tail", "accepted")]
    (text,) = fresh(df, "_text")
    base = df.select(*[F.col(f"`{c}`") for c in names])
    if not len(grades):
        return base.select(
            "*", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"), F.lit(True).alias("accepted")
        )
    fitted = fit(texts, buckets, grades)
    shared = df.sparkSession.sparkContext.broadcast((fitted.weights.astype(np.float32), fitted.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = OrdinalModel(*shared.value)
        for batch in batches:
            for part, data, offsets in pieces(batch, text):
                own, found = features(data, offsets)
                tails = model.tails(model.scores(own, found, part.num_rows))
                columns = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= accept)],
                    [f"c{i}" for i in range(len(names) + 3)],
                )

    fields = [T.StructField(f"c{i}", base.schema[c].dataType) for i, c in enumerate(names)]
    fields += [T.StructField(f"c{len(names) + i}", t) for i, t in enumerate((T.DoubleType(), T.DoubleType(), T.BooleanType()))]
    # columns travel under plain numbers, so no name can clash on the way
    moved = base.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias(text))
    return moved.mapInArrow(score, T.StructType(fields)).toDF(*names, "expected_grade", "tail", "accepted")
