"""Packing of tokenised documents into sequences of fixed length.

How many pieces there are of each length is all that a packing depends on, and there are at most ``CAPACITY`` lengths:
the counts go to the driver, whatever the size of the corpus. There the instance is reduced by dominance (Martello and
Toth): a set of at most three pieces that is at least as good as every other set with its longest piece is fixed for
good. Best fit in order of falling length packs the rest. The plan is a bounded list of patterns with multiplicities;
pieces are numbered within their length in parallel and look their place up in it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from peakloom.llm.bpe import Codec
from peakloom.llm.common import whole_text
from peakloom.session import cut_lineage

CAPACITY = 2048
#: Pieces of one length that are numbered in one group.
GROUP = 500
#: A text with a longer run of letters or of white space is encoded in time n log n instead of n^2.
LONG_RUN = 2_000

Pattern = tuple[int, list[tuple[int, int]]]  # copies, [(length, how often)]


def reduce_by_dominance(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, list[Pattern]]:
    """Fix dominating sets until none is left: the remaining counts by length, and the fixed patterns.

    For the longest piece j with room R beside it, and k the longest other piece that fits, {j, k} dominates if k fills R,
    if no two others fit, or if no three fit and no two that fit are longer than k together. {j} dominates if nothing fits.
    {j, k, b} dominates if k + b = R, no three fit, and no second piece of a fitting pair is longer than b. Each set is
    taken as often as its pieces allow, since taking pieces away never breaks these conditions.
    """
    counts, fixed = counts.copy(), []

    def take(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        copies = min(int(counts[x]) // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= copies * n
        fixed.append((copies, list(need.items())))

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                room = capacity - j
                counts[j] -= 1
                others = np.flatnonzero(counts)
                several = counts[others]
                counts[j] += 1
                fitting = others[others <= room]
                if not len(fitting):
                    take(j)
                    changed = True
                    continue
                k = int(fitting[-1])
                small = np.repeat(others[:3], np.minimum(several[:3], 3))[:3]
                if k == room or len(small) < 2 or small[:2].sum() > room:
                    take(j, k)
                    changed = True
                    continue
                if len(small) == 3 and small.sum() <= room:
                    break
                # the longest partner y <= x for every x
                twice = dict(zip(others.tolist(), several.tolist()))
                limit = np.minimum(room - fitting, fitting)
                place = np.searchsorted(fitting, limit, "right") - 1
                partner = np.where(place >= 0, fitting[np.maximum(place, 0)], 0)
                alone = (partner == fitting) & np.array([twice[int(x)] < 2 for x in fitting])
                partner = np.where(alone, np.where(place > 0, fitting[np.maximum(place - 1, 0)], 0), partner)
                pair = np.where(partner > 0, fitting + partner, 0)
                if pair.max() <= k:
                    take(j, k)
                    changed = True
                    continue
                b = room - k
                second = int(partner.max())
                if b > 0 and twice.get(b, 0) >= (2 if b == k else 1) and second <= b:
                    take(j, k, b)
                    changed = True
                    continue
                break
    return counts, fixed


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit over falling lengths. Sequences with the same room are handled together: the tightest one takes equal
    pieces until no more fit, then the next."""
    rooms: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = next((r for r in range(length, capacity) if rooms[r]), capacity)
            # a new sequence is opened only when no open one has room
            copies, items = rooms[room].pop() if room < capacity else (left, [])
            each = room // length
            full = min(copies, left // each)
            rest = left % each if full < copies else 0
            if full:
                rooms[room - each * length].append((full, [*items, (length, each)]))
            if rest:
                rooms[room - rest * length].append((1, [*items, (length, rest)]))
            unused = copies - full - (1 if rest else 0)
            if unused and room < capacity:
                rooms[room].append((unused, items))
            left -= full * each + rest
    return [p for group in rooms for p in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Slots (length, first rank, copies, offset, first sequence) sorted by length and first rank."""
    remaining, fixed = reduce_by_dominance(counts, capacity)
    slots, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for copies, items in fixed + best_fit(remaining, capacity):
        offset = 0
        for length, times in items:
            slots.append((length, used[length], copies, offset, sequence))
            used[length] += copies * times
            offset += length * times
        sequence += copies
    out = np.array(slots, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def ranks_of(tokenizer: dict) -> list[bytes]:
    """Tokens of a byte-level tokenizer file by id, added ones left out. Its characters stand for bytes: printable ones
    for themselves, the rest for code points from 256 on, in order."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    byte = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["id"] for t in tokenizer.get("added_tokens", [])}
    vocabulary = sorted((i, t) for t, i in tokenizer["model"]["vocab"].items() if i not in added)
    return [bytes(byte[c] for c in t) for _, t in vocabulary]


def added_tokens(tokenizer: dict) -> dict[str, int]:
    """Tokens that the file's library takes out of a text before anything else, with their ids."""
    found = tokenizer.get("added_tokens", [])
    if any(t.get(flag) for t in found for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what stands beside them are not supported")
    return {t["content"]: t["id"] for t in found}


class Tokenizer:
    """The encoder of one task: ids as the library of the tokenizer file gives them."""

    def __init__(self, tokens: list[bytes], pattern: str, added: dict[str, int]) -> None:
        import tiktoken

        ranks = {t: i for i, t in enumerate(tokens)}
        self.tokens, self.pattern, self.added = tokens, pattern, added
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.long_run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}").search
        self.careful: Codec | None = None
        longest_first = sorted(added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if added else lambda text: [text]

    def encode(self, text: str) -> list[int]:
        parts = self.cut(text)
        if len(parts) == 1:
            return self.encode_plain(text)
        return [i for n, part in enumerate(parts) for i in ([self.added[part]] if n % 2 else self.encode_plain(part))]

    def encode_plain(self, text: str) -> list[int]:
        if not self.long_run(text):
            return self.fast.encode_ordinary(text)
        self.careful = self.careful or Codec(self.tokens, self.pattern)
        return self.careful.encode(text)


_PIECE = ["piece", "start", "length", "ids_crc32", "ids"]


def tokenised(
    df: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, added_as_text: bool = False
) -> DataFrame:
    """Pieces of every row: doc_id, piece, start, length, ids_crc32, ids, and (block, row), which no other piece has. A
    row's ids end with ``end_id``.

    The vocabulary comes from the tokenizer file, the merging from tiktoken: the ids are those of the file's own library
    (tests compare them), which takes five times as long. Added tokens of the file that are written out in a text are these
    tokens, unless ``added_as_text``. The block is a number drawn by the task, so the table must be written before it is
    used twice.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        described = json.load(file)
    added = {} if added_as_text else added_tokens(described)
    shared = df.sparkSession.sparkContext.broadcast((ranks_of(described), added))
    id_type = to_arrow_type(df.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, special = shared.value
        tokenizer, block, row = Tokenizer(tokens, pattern, special), uuid.uuid4().bytes, 0
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = np.array([*tokenizer.encode(text.as_py()), end_id], "<u4").tobytes()
                n = len(raw) // 4
                first = n if n <= capacity else n % capacity or capacity
                start = 0
                for number, stop in enumerate(range(first, n + 1, capacity)):
                    ids = raw[4 * start : 4 * stop]
                    for c, v in zip(columns, (doc_id, number, start, stop - start, zlib.crc32(ids), np.frombuffer(ids, "<i4"))):
                        c.append(v)
                    start = stop
            made = len(columns[0])
            types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)] + [pa.array([block] * made, pa.binary()), pa.array(range(row, row + made), pa.int64())],
                ["doc_id", *_PIECE, "block", "row"],
            )
            row += made

    shape = T.StructType([
        df.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("block", T.BinaryType()), T.StructField("row", T.LongType()),
    ])
    return df.select("doc_id", whole_text().alias("text")).mapInArrow(run, shape)


def numbered(pieces: DataFrame, counts: np.ndarray) -> DataFrame:
    """Adds ``rank``, a number from 0 within the pieces of a length, to (block, row, length). A frequent length is numbered in
    many groups, whose sizes are added up."""
    groups = np.maximum(-(-counts // GROUP), 1)
    array = F.array(*[F.lit(int(g)) for g in groups])
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("block", "row"), F.get(array, F.col("length").cast("int"))))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_salt").orderBy("block", "row")
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_salt", "_in", "_before")


def pack(
    df: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY, added_as_text: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (its token ids), sequence_id, offset.

    Only documents longer than ``capacity`` are cut; all pieces but the first have full length. Null text counts as empty
    and has the end id alone. Equal rows are packed as often as they occur; an empty table gives no rows; other columns
    are ignored. Added tokens of the tokenizer file are taken as by its library.

    A full piece is a sequence by itself, with a negative number, and goes nowhere. The others find their place by their
    length and number alone; these narrow rows are shuffled and sorted, the ids are moved once and not sorted.
    """
    pieces = cut_lineage(tokenised(df, tokenizer_path, pattern, end_id, capacity, added_as_text))
    part = F.col("length") < capacity
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.filter(part).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[length] = n
    slots = plan(counts, capacity)
    # a long key makes one search of all slots: length and rank together
    width = np.int64(max(int(counts.max()), 1))
    starts = slots[:, 0] * width + slots[:, 1]
    shared = df.sparkSession.sparkContext.broadcast((slots, starts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = table[np.searchsorted(first, length * width + rank, "right") - 1]
            inside = rank - slot[:, 1]
            sequence, offset = slot[:, 4] + inside % slot[:, 2], slot[:, 3] + inside // slot[:, 2] * length
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("row"), pa.array(sequence), pa.array(offset)], ["block", "row", "sequence_id", "offset"])

    names = ["doc_id", *_PIECE, "sequence_id", "offset"]
    narrow = numbered(pieces.filter(part).select("block", "row", "length"), counts).select("block", "row", "length", "rank")
    placed = narrow.mapInArrow(place, "block binary, row long, sequence_id long, offset long")
    short = pieces.filter(part).join(placed.hint("shuffle_hash"), ["block", "row"]).select(*names)
    full = pieces.filter(~part).select(
        "doc_id", *_PIECE, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return short.unionByName(full)
