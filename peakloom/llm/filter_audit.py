"""How five quality filters interact, over every order in which they can be applied.

What a document does at every step of every order depends on the set of filters that it fails alone. Each such set is
mapped to one wide integer with a field of 64 bits for every outcome of all 600 steps (120 orders of five filters); the
integers of a part are summed as they are, and the fields of the sum are the counts of the part. A field cannot run into
the next one before a part has 2^64 documents. Equal sets are counted first, so a part adds up at most 128 integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from peakloom.llm.common import whole_text
from peakloom.session import cut_lineage

#: A: few words, B: few distinct words, C: many capitals, D: symbols, E: a copy of the text of a smaller doc_id.
FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8
SHAPE = (len(ORDERS), len(FILTERS), len(OUTCOMES))
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"

AUDIT = T.StructType(
    [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in (*OUTCOMES, "shapley")]
)


def failed_filters(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails; bytes split at the six white space characters of ASCII."""
    words = text.split()
    n = len(words)
    few, poor = n < 200, 100 * len(set(words)) < 50 * n
    shouting = 100 * (len(text) - len(text.translate(None, CAPITALS))) > 2 * n_chars
    return few | poor << 1 | shouting << 2 | (len(text) != len(text.translate(None, SYMBOLS))) << 3


def outcomes_of(mask: int, good: bool, toxic: bool) -> int:
    """The wide integer of one document that fails the filters of ``mask``."""
    fails = (mask >> np.array(ORDERS) & 1).astype(bool)
    gone = np.logical_or.accumulate(fails, axis=1)
    before = np.zeros_like(gone)
    before[:, 1:] = gone[:, :-1]
    removed, alone = fails & ~before, fails & (mask & mask - 1 == 0)
    fields = np.stack([~gone, removed, fails & before, alone, removed & good, removed & toxic], axis=2).astype("<u8")
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counts by order, step and outcome."""
    return np.frombuffer(total.to_bytes(int(np.prod(SHAPE)) * FIELD_BYTES, "little"), "<u8").reshape(SHAPE).astype(np.int64)


def audit_of(part: str, states: list[tuple[int, bool, bool, int]]) -> pa.Table:
    """All steps of all orders for one part, from (mask, good, toxic, documents)."""
    counts = unpacked(sum(n * outcomes_of(mask, good, toxic) for mask, good, toxic, n in states))
    letters = np.array(ORDERS)
    removed = counts[:, :, OUTCOMES.index("removed")]
    by_filter = np.array([removed[letters == f].sum() for f in range(len(FILTERS))])
    steps = letters.size
    columns = [
        pa.array([part] * steps, pa.string()),
        pa.array(["".join(FILTERS[f] for f in order) for order in ORDERS for _ in order], pa.string()),
        pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))),
        *[pa.array(counts[:, :, i].ravel()) for i in range(len(OUTCOMES))],
        pa.array(by_filter[letters].ravel()),
    ]
    return pa.Table.from_arrays(columns, names=AUDIT.names)


def _marked(df: DataFrame, part: str) -> DataFrame:
    """doc_id, part, mask (filters A to D) and a 128-bit digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, keys = [], []
            for text, n_chars in zip(batch.column("text").cast(pa.binary()), batch.column("n").to_pylist()):
                data = text.as_py()
                masks.append(failed_filters(data, n_chars))
                keys.append(hashlib.blake2b(data, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())],
                ["doc_id", "part", "mask", "text_key"],
            )

    shape = T.StructType([
        df.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("text_key", T.BinaryType())
    ])
    text = whole_text()
    part_name = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part")
    return df.select("doc_id", part_name, text.alias("text"), F.char_length(text).alias("n")).mapInArrow(run, shape)


def states(df: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Documents by part, mask (all five filters), good and toxic: n. At most 128 rows per part.

    Which of a group of equal texts comes first needs no join of the documents themselves: per text the documents are
    counted by state, with the smallest doc_id of each state and how many rows have it, and these counts meet.
    """
    rows = _marked(df, part).groupBy("text_key", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # rows without doc_id have no label; the salt keeps them from meeting in one task
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text_key")).otherwise(F.lit(0).cast("long"))
    labelled = rows.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").select(
        "text_key", "doc_id", "part", "mask", "n",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    has_id = F.col("doc_id").isNotNull()
    by_text = cut_lineage(labelled.groupBy("text_key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("without_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("low"),
    ))
    first = by_text.groupBy("text_key").agg(F.min("low.doc_id").alias("first"))
    is_first = F.coalesce(F.col("low.doc_id") == F.col("first"), F.lit(False))
    originals = F.col("without_id") + F.when(is_first, F.col("low.n")).otherwise(F.lit(0))
    split = by_text.join(first, "text_key").select("part", "mask", "good", "toxic", "n", originals.alias("originals"))
    copy_bit = 1 << FILTERS.index("E")

    def both(mask: Column, n: Column) -> Column:
        return F.struct(mask.cast("int").alias("mask"), n.alias("n"))

    pair = F.explode(F.array(both(F.col("mask"), F.col("originals")), both(F.col("mask") + copy_bit, F.col("n") - F.col("originals"))))
    return (
        split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum("originals").alias("originals"))
        .select("part", "good", "toxic", pair.alias("s"))
        .select("part", F.col("s.mask").alias("mask"), "good", "toxic", F.col("s.n").alias("n")).filter("n > 0")
    )


def audit(df: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: the counts of ``OUTCOMES`` and the filter's Shapley total.

    ``labels`` has doc_id, quality and toxic; a document is good (toxic) if any of its label rows says 1. Null text counts
    as empty, a null part is the part ''. Rows without doc_id have no label, never fail E and make no other row fail it;
    rows that share a doc_id are no copies of one another. Every row counts, equal rows too; an empty table gives no rows;
    other columns are ignored.
    """

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n")]
        return audit_of(table.column("part")[0].as_py(), list(zip(*columns)))

    return states(df, labels, part).groupBy("part").applyInArrow(run, AUDIT)
