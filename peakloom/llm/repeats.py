"""Repeated passages by enhanced suffix arrays over content-anchored stretches.

A suffix array of a corpus fits no task, so texts are first cut where their content says so. Of every 200-byte string
the 80-byte part with the smallest hash is its anchor; equal strings have equal anchors at equal places. Only anchors
that occur again anywhere are followed up, and all strings with one anchor form one stretch of at most 320 bytes.
Suffixes of stretches with the same anchor are put in order together, with the lengths of common prefixes, and a stack
scans the common-prefix intervals: an interval whose occurrences have different left neighbours is a maximal repeat
(within the stretches). A stretch that occurs as a whole several times is one text to the suffix array, and a repeat by
itself.

Two suffixes that share 200 bytes have their anchor at the same place, so the suffixes of an anchor can be dealt to tasks
by the place without parting any interval, and those of one place by their first 200 bytes. A suffix always goes on to the
end of its stretch and knows the byte before it, so intervals do not depend on how an anchor was dealt. Tasks order small
groups by a suffix array in memory; suffixes of anchors with very many stretches are ordered by Spark's sort, and the stack
scans the stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from peakloom.llm.common import row_key, whole_text
from peakloom.llm.vector import mix, pieces, powers, prefix_sums
from peakloom.session import cut_lineage

LENGTH = 200
GRAM = 80
WINDOW = LENGTH - GRAM + 1
#: A text longer than this is anchored in parts that overlap by LENGTH - 1 bytes.
PART = 4 << 20
#: Distinct stretches of one anchor per slice of places, and beyond which number their suffixes are ordered by Spark's sort.
PER_SLICE = 150
IN_MEMORY = PER_SLICE * WINDOW
BLOCK = 1 << 20
#: Tasks that share the rows of one stretch, and ranks of one class of suffixes that are listed together.
SALTS = 4
RANKS = 1024

_LOW = np.uint64((1 << 24) - 1)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of all texts: (text, first string, place of the anchor in the stretch, strings, anchor hash, stretch hash)."""
    n = len(data)
    sizes = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not sizes.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_sums(data)
    scale = powers(n + 1, "down")
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * scale[: n - GRAM + 1])
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    lowest = sliding_minimum(keys, WINDOW)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[owner]
    at = lowest[start]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    first, text = start[head], owner[head]
    anchor = (at[head] & _LOW).astype(np.int64)
    stop = first + count - 1 + LENGTH
    whole = mix((sums[stop] - sums[first]) * scale[first] + count.astype(np.uint64))
    return text, first - offsets[text], anchor - first, count, grams[anchor], whole


def _long_text(text: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors`` of one text by parts: a part sees a full stretch on both sides and keeps the stretches that begin in it."""
    for at in range(0, max(len(text) - LENGTH + 1, 1), PART):
        begin = max(at - WINDOW, 0)
        own = text[begin : at + PART + WINDOW + LENGTH - 1]
        found = anchors(own, np.array([0, len(own)]))
        first = found[1] + begin
        mine = (first >= at) & (first < at + PART)
        yield tuple(v[mine] for v in (found[0], first, *found[2:]))


def _pack(first: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    return first << 14 | place << 7 | count


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            keys = part.column("key")
            if len(data) <= PART + LENGTH:
                sets = [(keys, anchors(data, offsets))]
            else:  # a piece above the limit may end with a long text after short ones
                sets = [(keys[row : row + 1], found) for row in range(part.num_rows) for found in _long_text(data[offsets[row] : offsets[row + 1]])]
            for own_keys, (text, first, place, count, gram, whole) in sets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), own_keys.take(pa.array(text)), pa.array(_pack(first, place, count))],
                    ["anchor", "stretch", "key", "pos"],
                )


def _first(pos):  # noqa: ANN001, ANN202
    return F.shiftright(pos, 14)


def _count(pos):  # noqa: ANN001, ANN202
    return pos.bitwiseAND(127)


_CUT = pa.schema([
    ("anchor", pa.int64()), ("slice", pa.int32()), ("stretch", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("offset", pa.int32()),
    ("suffixes", pa.int32()), ("before", pa.int32()), ("copies", pa.int64()), ("bytes", pa.binary()),
])
_CUT_SQL = "anchor long, slice int, stretch long, key binary, start long, offset int, suffixes int, before int, copies long, bytes binary"


def _slices_of(place: int, count: int, slices: int) -> Iterator[tuple[int, int, int]]:
    """(number, first, last string) of a stretch by the place of the anchor in the string, which is the same for equal strings."""
    cut = 0
    while cut < count:
        number = (place - cut) * slices // WINDOW  # places fall as strings move on
        last = min(max(place - -(-number * WINDOW // slices), cut), count - 1)
        yield number, cut, last
        cut = last + 1


def _stretch_rows(batches: Iterator[pa.RecordBatch], each: bool) -> Iterator[pa.RecordBatch]:
    """Wanted stretches from the first string of each of their slices on; with ``each`` from every string on."""
    for batch in batches:
        out: list[list] = [[] for _ in _CUT]
        for text, key, wanted in zip(batch.column("text"), batch.column("key").to_pylist(), batch.column("wanted").to_pylist()):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            for w in wanted:
                first, place, count = w["pos"] >> 14, w["pos"] >> 7 & 127, w["pos"] & 127
                slices = WINDOW if each else min(max(-(-w["distinct"] // PER_SLICE), 1), WINDOW)
                stop = first + count - 1 + LENGTH
                for number, cut, last in _slices_of(place, count, slices):
                    before = data[first + cut - 1] if cut else -1
                    row = (w["anchor"], number, w["stretch"], key, first + cut, cut, last - cut + 1, before, w["copies"], data[first + cut : stop])
                    for c, v in zip(out, row):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CUT)], schema=_CUT)


def suffix_array(stretches: list[bytes], counts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Enhanced suffix array of the first ``counts`` suffixes of each text: (text, offset) in suffix order, the length of the
    prefix shared with the one before, and the byte to the left (a number of its own where ``before`` the text is -1)."""
    sizes = np.array([len(s) for s in stretches])
    # every stretch ends in eight bytes of its own that occur in no UTF-8 text
    ends = [b"\xff" + n.to_bytes(7, "little") for n in range(len(stretches))]
    text = np.frombuffer(b"".join(x for pair in zip(stretches, ends) for x in pair) + bytes(8), np.uint8)
    n = len(text) - 8
    packed = np.zeros(n, np.uint64)
    for i in range(8):
        packed = packed << np.uint64(8) | text[i : i + n]
    ranks = [np.unique(packed, return_inverse=True)[1]]
    steps = [8]
    while steps[-1] < sizes.max() + 8:
        old, h = ranks[-1], steps[-1]
        second = np.zeros(n, np.int64)
        if h < n:
            second[: n - h] = old[h:] + 1
        ranks.append(np.unique(old * np.int64(n + 2) + second, return_inverse=True)[1])
        steps.append(2 * h)
    begin = np.concatenate([[0], np.cumsum(sizes + 8)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begin[owner] + offset
    order = np.argsort(ranks[-1][place], kind="stable")
    owner, offset, place = owner[order], offset[order], place[order]
    a, b = place[:-1], place[1:]
    shared = np.zeros(len(a), np.int64)
    for rank, h in zip(ranks[::-1], steps[::-1]):
        same = rank[np.minimum(a + shared, n - 1)] == rank[np.minimum(b + shared, n - 1)]
        shared += h * same
    x, y = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
    differ = packed[x] ^ packed[y]
    for i in range(1, 8):
        shared += (differ >> np.uint64(64 - 8 * i)) == 0
    room = sizes[owner] - offset
    shared = np.minimum(shared, np.minimum(room[:-1], room[1:]))
    outside = np.where(before[owner] >= 0, before[owner], -1 - np.arange(len(place)))
    left = np.where(offset > 0, text[place - 1].astype(np.int64), outside)
    return owner, offset, np.concatenate([[0], shared]), left


def maximal_repeats(shared: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """Common-prefix intervals of at least LENGTH whose occurrences have different left neighbours: (length, from, to) as
    half-open ranges of the suffix array, inner intervals first."""
    found = []
    deep = shared >= LENGTH
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    many = -2 - len(left)
    for a, b in zip(edge[::2] - 1, edge[1::2]):  # suffixes a .. b - 1 share LENGTH bytes
        neighbours = left[a:b]
        if neighbours[0] >= 0 and (neighbours == neighbours[0]).all():
            continue  # the strings one byte to the left repeat as well
        stack: list[list[int]] = []  # length, from, left neighbour or many
        for i in range(a, b + 1):
            depth = int(shared[i]) if a < i < b else 0
            start, state = i, None
            if i > a:
                start, state = i - 1, int(left[i - 1])
            while stack and stack[-1][0] > depth:
                length, start, mine = stack.pop()
                state = mine if state is None or state == mine else many
                if state == many:
                    found.append((length, start, i))
            if depth:
                if stack and stack[-1][0] == depth:
                    if stack[-1][2] != state:
                        stack[-1][2] = many
                else:
                    stack.append([depth, start, state])
    return found


def _solved(block: pa.Table, every: bool) -> pa.RecordBatch:
    """Occurrences of the maximal repeats of complete groups: each suffix of a stretch that occurs once with its longest
    repeat, or with ``every`` all suffixes of all repeats."""
    texts, copies = block.column("bytes").to_pylist(), block.column("copies").to_numpy()
    owner, offset, shared, left = suffix_array(texts, block.column("suffixes").to_numpy(), block.column("before").to_numpy())
    repeats = maximal_repeats(shared, left)
    if every:
        members = np.concatenate([np.arange(a, b) for _, a, b in repeats]) if repeats else np.zeros(0, np.int64)
        digests = [hashlib.md5(texts[owner[a]][offset[a] : offset[a] + size]).digest() for size, a, _ in repeats]
        times = [b - a for _, a, b in repeats]
        rows, inside = owner[members], offset[members]
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, n in zip(digests, times) for _ in range(n)], pa.binary()), pa.array(np.repeat([size for size, _, _ in repeats], times).astype(np.int64)),
             block.column("anchor").take(pa.array(rows)).combine_chunks(), block.column("stretch").take(pa.array(rows)).combine_chunks(),
             pa.array((block.column("offset").to_numpy()[rows] + inside).astype(np.int32))],
            schema=_MEMBER,
        )
    length = np.zeros(len(owner), np.int64)
    for size, a, b in repeats:
        length[a:b] = np.maximum(length[a:b], size)
    hit = np.flatnonzero(length)
    hit = hit[copies[owner[hit]] == 1]
    start = block.column("start").to_numpy()[owner[hit]] + offset[hit]
    return pa.RecordBatch.from_arrays(
        [block.column("key").take(pa.array(owner[hit])).combine_chunks(), pa.array(start << 10 | length[hit])], schema=_SPAN
    )


_MEMBER = pa.schema([("group", pa.binary()), ("length", pa.int64()), ("anchor", pa.int64()), ("stretch", pa.int64()), ("offset", pa.int32())])
#: ``span`` holds the start and, in the last ten bits, the length: no span is longer than a stretch.
_SPAN = pa.schema([("key", pa.binary()), ("span", pa.int64())])


def _repeat_rows(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """``_solved`` for groups that arrive sorted by anchor and slice, several small ones at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            anchor, part = table.column("anchor").to_numpy(), table.column("slice").to_numpy()
            starts = np.append(np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1, [])
            lengths = np.cumsum([len(x) for x in table.column("bytes").to_pylist()])
            done = 0
            for s in starts.astype(int):
                if lengths[s - 1] - (lengths[done - 1] if done else 0) >= BLOCK // 2 or s == starts[-1]:
                    yield _solved(table.slice(done, s - done).combine_chunks(), every)
                    done = s
            held = table.slice(done).to_batches()
            size = sum(b.nbytes for b in held) if done else 0
    if held and sum(b.num_rows for b in held):
        yield _solved(pa.Table.from_batches(held).combine_chunks(), every)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - -(-differ.bit_length() // 8)


class _Stream:
    """The stack scan over suffixes that arrive in order; only the stack is held, whatever the number of suffixes."""

    def __init__(self) -> None:
        self.previous, self.group, self.left, self.rank = b"", b"", -1, -1
        self.stack: list[list] = []  # length, first rank, left neighbour or None for many
        #: (class, digest of the repeat, length, first rank, last rank)
        self.found: list[tuple[bytes, bytes, int, int, int]] = []

    def close(self, depth: int) -> tuple[int, int | None]:
        """Leave the intervals deeper than ``depth``; where the last one began and what stood left of its members."""
        start, state = self.rank, self.left
        while self.stack and self.stack[-1][0] > depth:
            length, start, mine = self.stack.pop()
            state = mine if state == mine else None
            if state is None:
                self.found.append((self.group, hashlib.md5(self.previous[:length]).digest(), length, start, self.rank))
        return start, state

    def add(self, data: bytes, before: int) -> int:
        """The next suffix; the length it shares with the one before, 0 where a new class begins."""
        shared = _common(self.previous, data)
        if shared < LENGTH:
            self.close(0)
            self.group, self.rank, shared = hashlib.md5(data[:LENGTH]).digest(), 0, 0
            self.stack = []
        else:
            start, state = self.close(shared)
            if self.stack and self.stack[-1][0] == shared:
                if self.stack[-1][2] != state:
                    self.stack[-1][2] = None
            else:
                self.stack.append([shared, start, state])
            self.rank += 1
        # the start of a stretch is unlike any other left neighbour
        self.previous, self.left = data, before if before >= 0 else None
        return shared


_SCANNED = pa.schema([
    ("class", pa.binary()), ("rank", pa.int64()), ("last", pa.int64()), ("group", pa.binary()), ("length", pa.int64()),
    ("anchor", pa.int64()), ("stretch", pa.int64()), ("offset", pa.int32()),
])


def _scan_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (class, rank, anchor, stretch, offset) and repeats (class, rank, last, group, length) of sorted suffixes."""
    stream = _Stream()

    def repeats() -> pa.RecordBatch:
        found, stream.found = stream.found, []
        columns = [list(c) for c in zip(*[(c, a, b, g, n, None, None, None) for c, g, n, a, b in found])] or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCANNED)], schema=_SCANNED)

    for batch in batches:
        classes, ranks = [], []
        for data, before in zip(batch.column("bytes").to_pylist(), batch.column("before").to_pylist()):
            stream.add(data, before)
            classes.append(stream.group)
            ranks.append(stream.rank)
        nothing = [pa.nulls(batch.num_rows, _SCANNED.field(i).type) for i in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(classes, pa.binary()), pa.array(ranks, pa.int64()), *nothing, *[batch.column(c) for c in ("anchor", "stretch", "offset")]],
            schema=_SCANNED,
        )
        yield repeats()
    stream.close(0)
    yield repeats()


def _span_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of sorted suffixes that share 200 bytes or more with the one before or after, in stretches that occur once."""
    stream, held = _Stream(), None
    for batch in chain(batches, [None]):
        out: list[list] = [[], []]
        rows = [(None, 0, b"", 0, 1)] if batch is None else zip(*[batch.column(c).to_pylist() for c in ("key", "start", "bytes", "before", "copies")])
        for key, start, data, before, copies in rows:
            shared = stream.add(data, before)
            if held is not None and held[2] == 1 and max(held[3], shared):
                out[0].append(held[0])
                out[1].append(held[1] << 10 | max(held[3], shared))
            held = (key, start, copies, shared)
        stream.found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SPAN)], schema=_SPAN)


class _Corpus:
    """Written tables: anchored stretches of all texts whose anchor occurs again, and what is known about them."""

    def __init__(self, df: DataFrame) -> None:
        self.docs = _keyed(df)
        found = self.docs.select("key", "text").mapInArrow(_anchor_rows, "anchor long, stretch long, key binary, pos long")
        again = cut_lineage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
        #: one row per stretch of each text
        self.rows = cut_lineage(found.join(again, "anchor", "left_semi"))
        place = F.struct("key", "pos")
        self.stretches = cut_lineage(self.rows.groupBy("anchor", "stretch").agg(
            F.count(F.lit(1)).alias("copies"), F.min_by("key", place).alias("key"), F.min_by("pos", place).alias("pos")
        ))
        #: anchors whose stretches differ
        self.unclear = cut_lineage(self.stretches.groupBy("anchor").agg(
            F.count(F.lit(1)).alias("distinct"), F.min("copies").alias("least")
        ).filter("distinct > 1"))

    def copied(self) -> DataFrame:
        """Rows of stretches that occur several times. A stretch that very many rows share is looked up by several tasks."""
        salted = cut_lineage(self.stretches.filter("copies > 1").select("anchor", "stretch")).withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        )
        salt = F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int")
        return self.rows.withColumn("_salt", salt).join(salted, ["anchor", "stretch", "_salt"], "left_semi").drop("_salt")

    def cut_out(self, condition: str, each: bool = False) -> DataFrame:
        """Bytes of the distinct stretches of the anchors of ``unclear`` that meet a condition, by slices of places."""
        some = self.stretches.join(self.unclear.filter(condition).select("anchor", "distinct"), "anchor").groupBy("key").agg(
            F.collect_list(F.struct("anchor", "stretch", "pos", "copies", "distinct")).alias("wanted")
        )
        return self.texts_of(some, "wanted").mapInArrow(partial(_stretch_rows, each=each), _CUT_SQL)

    def texts_of(self, rows: DataFrame, column: str) -> DataFrame:
        """key, text and a column of one row per key. Equal rows have one key: their text is taken once."""
        found = self.docs.select("key", "text").join(rows, "key")
        return found.groupBy("key").agg(F.first("text").alias("text"), F.first(column).alias(column))

    def in_memory(self, condition: str, every: bool, schema: str) -> DataFrame:
        grouped = self.cut_out(f"distinct <= {IN_MEMORY} and {condition}").repartition("anchor", "slice").sortWithinPartitions("anchor", "slice")
        return grouped.mapInArrow(partial(_repeat_rows, every=every), schema)

    def sorted_suffixes(self, condition: str) -> DataFrame:
        """Every suffix of the anchors with very many stretches, in order; a task has whole classes of equal first 200 bytes."""
        each = self.cut_out(f"distinct > {IN_MEMORY} and {condition}", each=True)
        dealt = each.repartition("anchor", "slice", F.xxhash64(F.substring("bytes", 1, LENGTH)))
        return dealt.sortWithinPartitions("anchor", "slice", "bytes", "stretch")


def _keyed(df: DataFrame) -> DataFrame:
    # equal rows share a key and its results
    return df.select("doc_id", row_key().alias("key"), whole_text().alias("text"))


def _spans(corpus: _Corpus) -> DataFrame:
    """(key, span) that together cover every byte of a repeated 200-byte string."""
    length = _count(F.col("pos")) + (LENGTH - 1)
    by_copies = corpus.copied().select("key", F.shiftleft(_first(F.col("pos")), 10).bitwiseOR(length).alias("span"))
    # where every stretch of an anchor occurs several times, nothing is left to find out
    found = by_copies.unionByName(corpus.in_memory("least = 1", False, "key binary, span long"))
    if corpus.unclear.filter(f"distinct > {IN_MEMORY} and least = 1").isEmpty():
        return found
    return found.unionByName(corpus.sorted_suffixes("least = 1").mapInArrow(_span_sorted, "key binary, span long"))


def repeat_groups(df: DataFrame) -> DataFrame:
    """All occurrences of all maximal repeats: group (digest of the repeated string), length, doc_id, start.

    A repeat has at least 200 bytes and lies within a stretch; it is maximal there: its occurrences have different left
    neighbours, and no longer string has the same occurrences. Each is listed with every place where it occurs, also
    inside longer repeats. Rows that are equal are all listed.
    """
    corpus = _Corpus(df)
    member = "group binary, length long, anchor long, stretch long, offset int"
    listed = corpus.in_memory("true", True, member)
    scanned = cut_lineage(corpus.sorted_suffixes("true").mapInArrow(
        _scan_sorted, "class binary, rank long, last long, group binary, length long, anchor long, stretch long, offset int"
    ))
    ranks = lambda c: F.floor(F.col(c) / RANKS).cast("long")
    blocks = scanned.filter("group is not null").select(
        "class", "group", "length", F.col("rank").alias("_from"), F.col("last").alias("_to"), F.explode(F.sequence(ranks("rank"), ranks("last"))).alias("_ranks")
    )
    members = scanned.filter("group is null").select("class", "rank", "anchor", "stretch", "offset", ranks("rank").alias("_ranks"))
    by_sort = members.join(blocks, ["class", "_ranks"]).filter("rank between _from and _to").select("group", "length", "anchor", "stretch", "offset")
    # a stretch with copies is a repeat as a whole
    places = corpus.stretches.filter("copies > 1").groupBy("key").agg(F.collect_list(F.struct("anchor", "stretch", "pos")).alias("places"))
    copies = corpus.texts_of(places, "places").select("text", F.explode("places").alias("p")).select("text", "p.*")
    size = _count(F.col("pos")) + (LENGTH - 1)
    whole = F.substring(F.encode("text", "UTF-8"), _first(F.col("pos")).cast("int") + 1, size.cast("int"))
    by_copies = copies.select(F.unhex(F.md5(whole)).alias("group"), size.cast("long").alias("length"), "anchor", "stretch", F.lit(0).alias("offset"))
    found = listed.unionByName(by_sort).unionByName(by_copies)
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int")
    placed = corpus.rows.withColumn("_salt", salt).join(salted, ["anchor", "stretch", "_salt"]).select(
        "group", "length", "key", (_first(F.col("pos")) + F.col("offset")).alias("start")
    ).distinct()
    return placed.join(corpus.docs.select("key", "doc_id"), "key").select("group", "length", "doc_id", "start")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = text.as_buffer().to_pybytes()
            first = last = np.zeros(0, np.int64)
            if spans.is_valid:
                packed = spans.values.to_numpy()
                start = packed >> 10
                stop = start + (packed & 1023)
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(stop[order])
                new = np.append(True, start[1:] > reach[:-1])
                first, last = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
            kept = b"".join(data[a:b] for a, b in zip(np.append(0, last), np.append(first, len(data))))
            for c, v in zip(out, (len(data), len(data) - len(kept), len(first), kept)):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(df: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that are left; a cut
    may fall inside a character).

    A byte goes if a 200-byte string that starts at two places or more covers it; strings do not cross rows and are judged
    on the input. Null text counts as empty. Rows that are equal repeat each other. A null doc_id is a value like any
    other. An empty table gives no rows; other columns are ignored.
    """
    corpus = _Corpus(df)
    spans = _spans(corpus).groupBy("key").agg(F.collect_list("span").alias("spans"))
    shape = T.StructType([df.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])
    return corpus.docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_remove, shape)
