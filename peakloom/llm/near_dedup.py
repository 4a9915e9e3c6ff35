"""Near-duplicate classes by DartMinHash signatures, banded joins and an exact check.

A text is a weighted set: its five-word shingles, each weighing as often as it occurs; the similarity of two texts is
their weighted Jaccard similarity. The signature throws hashed darts: every element owns a region as wide as its weight,
darts fall on it as a Poisson process over rising ranks, and the earliest dart of each coordinate is kept. Two texts keep
the same dart with a probability equal to their similarity.

Texts that agree in a band are candidates. Inside a bucket members are first compared with a few of its members only, so
large groups of copies cost rows in proportion to their size; whatever that leaves undecided is compared pair by pair.
Every link is an exact comparison of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from peakloom.llm.common import fresh, row_key, whole_text
from peakloom.llm.vector import mix, pieces, text_buffer, word_hashes
from peakloom.session import cut_lineage

WORDS = 5
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
SIMILARITY = 0.8
#: Words of 64 bits in the bitmap that bounds the common part of two texts.
BITMAP = 16

_place = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words and the first of each text. A text of one to four words is one shingle."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(first[-1]) - first[owner] + bounds[owner]
    total = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = at + k < bounds[owner + 1]
        total[inside] += words[at[inside] + k] * _place[k]
    return mix(total), first


def cells(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number per unit of weight: (element, how many equal ones came before), sorted within each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingles, owner))
    s, o = shingles[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
    return mix(s + mix((np.arange(len(s)) - start).astype(np.uint64) + np.uint64(7)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(cell: np.ndarray, first: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Signature matrix (texts x k). Texts without cells keep zeros.

    Ranks up to (k ln k + 2k) / weight hit all coordinates of most texts; the search goes on at twice the rank for the
    texts where one is still empty.
    """
    n = len(first) - 1
    weight = np.diff(first)
    out = np.zeros((n, k), np.uint64)
    todo, reach = np.flatnonzero(weight), (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    while len(todo):
        counts = weight[todo]
        owner = np.repeat(np.arange(len(todo)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[todo], counts)
        source, limit = cell[at], reach[todo][owner]
        rank, state = np.zeros(len(source)), source
        ranks, slots, darts = [], [], []
        while len(source):
            state = mix(state + np.uint64(0x632BE59BD9B4E019))
            rank = rank - np.log(_uniform(state))
            live = rank < limit
            rank, state, source, owner, limit = rank[live], state[live], source[live], owner[live], limit[live]
            dart = mix(state ^ source)
            ranks.append(rank)
            slots.append(owner * k + (dart >> np.uint64(33)).astype(np.int64) % k)
            darts.append(dart)
        ranks, slots, darts = np.concatenate(ranks), np.concatenate(slots), np.concatenate(darts)
        order = np.argsort(ranks)[::-1]
        kept = np.zeros(len(todo) * k, np.uint64)
        hit = np.zeros(len(todo) * k, bool)
        kept[slots[order]] = darts[order]  # the earliest is written last
        hit[slots] = True
        full = hit.reshape(-1, k).all(axis=1)
        out[todo[full]] = kept.reshape(-1, k)[full]
        todo = todo[~full]
        reach[todo] *= 2
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    total = mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :] + np.zeros((len(signature), 1), np.uint64)
    for r in range(ROWS):
        total = mix(total ^ parts[:, :, r])
    return total.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            words, bounds = word_hashes(data, offsets)
            shingles, first = shingle_hashes(words, bounds)
            bands = band_hashes(signatures(cells(shingles, first), first))
            sizes = np.diff(first)
            node = [hashlib.md5(words[a:b].tobytes()).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("_key"), pa.array(node, pa.binary()), pa.array(sizes), lists],
                ["doc_id", "_key", "node", "n", "bands"],
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose weighted Jaccard similarity reaches the threshold."""
    for batch in batches:
        for part, data, offsets in pieces(batch, "a_text"):
            sides = []
            for rows in ((data, offsets), text_buffer(part.column("b_text"))):
                shingles, first = shingle_hashes(*word_hashes(*rows))
                cell = cells(shingles, first)
                sides.append((cell, np.repeat(np.arange(part.num_rows), np.diff(first)), np.diff(first)))
            (x, x_row, x_n), (y, y_row, y_n) = sides
            value, row = np.concatenate([x, y]), np.concatenate([x_row, y_row])
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            # cells of one text are distinct, so an equal neighbour comes from the other text
            both = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][both], minlength=part.num_rows)
            near = common >= SIMILARITY * (x_n + y_n - common) - 1e-9
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the exact check, written to the shared folder."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text")
    return cut_lineage(both.mapInArrow(_compare, "a binary, b binary"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) of the nodes in links (a, b); comp is the smallest node connected to it.

    Each round takes the smallest label of a node's neighbours and then the label of its label, so labels travel twice
    as far every round. Only minima are aggregated: a node with very many links needs no memory.
    """
    both = cut_lineage(links.union(links.select("b", "a")).distinct().toDF("node", "other"))
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = cut_lineage(
            lower.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp"))
        )
        labels = after.select("node", "comp")
        if after.filter("old <> comp").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """Components after more links: only what the new links join is labelled anew."""
    if found.isEmpty():
        return comps
    ends = found.select("a", "b")
    for side in ("a", "b"):
        named = comps.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
        ends = ends.join(named, side, "left").withColumn(f"{side}_comp", F.coalesce(f"{side}_comp", side))
    joined = components(ends.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    moved = comps.join(joined.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    single = joined.join(comps, "node", "left_anti")
    return cut_lineage(moved.union(single))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    mixed = cut_lineage(members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket"))
    return cut_lineage(members.join(mixed, "bucket", "left_semi"))


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component, with their component."""
    labelled = members.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return _mixed(cut_lineage(labelled.select("bucket", "node", "n", "mates", "shareable", "comp")))


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            shingles, first = shingle_hashes(*word_hashes(data, offsets))
            cell = pa.array(cells(shingles, first).view(np.int64))
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            columns = [pa.array(part.column(c).to_numpy()[owner]) for c in ("short", "comp")]
            yield pa.RecordBatch.from_arrays([cell, *columns], ["cell", "short", "comp"])


def _without_hopeless(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members that may still be linked in their bucket, with ``shareable``, the cells that a text of another component
    has too.

    Two texts of different components have at most the smaller number of shareable cells in common. A text with many
    cells that only its own component has can reach the similarity with none that is as long as the shortest of the
    bucket: copies that were edited too much, and groups that differ enough, leave their bucket before any pair is
    formed. Both tests are bounds, so no link is lost. (Texts go by 64-bit hashes here.)
    """
    short = F.xxhash64("node").alias("short")
    nodes = members.select("node", F.xxhash64("comp").alias("comp")).distinct()
    cell = texts.join(nodes, "node").select(short, "comp", "text").mapInArrow(_cell_rows, "cell long, short long, comp long")
    common = cell.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("cell")
    shared = cell.select("cell", "short").join(cut_lineage(common), "cell", "left_semi").groupBy("short").agg(F.count(F.lit(1)).alias("met"))
    shortest = cut_lineage(members.groupBy("bucket").agg(F.min("n").alias("shortest")))
    marked = cut_lineage(members.drop("shareable").withColumn("short", short).join(cut_lineage(shared), "short", "left").select(
        "bucket", "node", "n", "mates", "comp", F.coalesce("met", F.lit(0)).alias("shareable")
    ))
    hopeful = _can_reach(F.col("shareable"), F.col("n") + F.greatest("shortest", "shareable"))
    return marked.join(shortest, "bucket").filter(hopeful).drop("shortest")


def _can_reach(common: Column, sizes: Column) -> Column:
    # common / (sizes - common) >= similarity
    return common * F.lit(1 + SIMILARITY) + F.lit(1e-6) >= sizes * F.lit(SIMILARITY)


def _star_pairs(members: DataFrame, turn: int, roots: int = 3) -> DataFrame:
    """Every member with a few members of its bucket that belong to another component: the one with the most mates over
    all its buckets, and others chosen by hash."""
    root = F.struct("node", "n", "shareable", "comp")
    pick = [F.max_by(root, F.struct("mates", "node")).alias("r0")]
    pick += [F.min_by(root, F.xxhash64("node", F.lit(turn * roots + r))).alias(f"r{r}") for r in range(1, roots)]
    chosen = cut_lineage(members.groupBy("bucket").agg(*pick))
    met = members.join(chosen, "bucket").select(
        "node", "n", "shareable", "comp", F.explode(F.array_distinct(F.array(*[f"r{r}" for r in range(roots)]))).alias("r")
    )
    met = met.filter((F.col("comp") != F.col("r.comp")) & _can_reach(F.least("shareable", "r.shareable"), F.col("n") + F.col("r.n")))
    return met.select(*_pair(F.col("node"), F.col("r.node"))).distinct()


def _bitmap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            shingles, first = shingle_hashes(*word_hashes(data, offsets))
            spot = (cells(shingles, first) >> np.uint64(40)).astype(np.int64) % (64 * BITMAP)
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            odd = np.bincount(owner * (64 * BITMAP) + spot, minlength=part.num_rows * 64 * BITMAP) & 1
            words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BITMAP), pa.array(words))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "bits"])


def _all_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components in a bucket that can reach the similarity.

    A text's bitmap has a bit for every odd number of cells that hash there. Bits in which two bitmaps differ are at most
    the cells that the texts do not share, which bounds what they do: pairs beyond the bound are never written.
    """
    bits = texts.join(members.select("node").distinct(), "node").select("node", "text").mapInArrow(_bitmap_rows, "node binary, bits array<long>")
    words = [f"w{i}" for i in range(BITMAP)]
    flat = cut_lineage(bits.select("node", *[F.col("bits")[i].alias(w) for i, w in enumerate(words)]))
    full = cut_lineage(members.select("bucket", "node", "n", "shareable", "comp").join(flat, "node"))
    left, right = (full.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "shareable", "comp", *words)]) for side in "xy")
    sizes = F.col("x_n") + F.col("y_n")
    differ = sum((F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in words), F.lit(0))
    reach = _can_reach(F.least("x_shareable", "y_shareable"), sizes) & _can_reach((sizes - differ) / 2, sizes)
    met = left.join(right, "bucket").filter((F.col("x_comp") < F.col("y_comp")) & reach)
    return met.select(*_pair(F.col("x_node"), F.col("y_node"))).distinct()


def _components_of_rows(df: DataFrame, star_turns: int = 2) -> DataFrame:
    """One row per input row: doc_id, _key and comp, which names the class: the smallest node of what links connect, or the
    row's own node or key."""
    shape = T.StructType([
        T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("_key", T.BinaryType()), T.StructField("node", T.BinaryType()),
        T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    sketch = cut_lineage(df.select("doc_id", row_key().alias("_key"), whole_text().alias("text")).mapInArrow(_sketch, shape))
    nodes = sketch.filter("node is not null").groupBy("node").agg(F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    entries = nodes.select("node", "_key", "n", F.explode("bands").alias("bucket"))
    shared = cut_lineage(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = cut_lineage(entries.join(shared, "bucket"))
    # the text that others were made from shares more bands with each of them than they do with one another
    central = cut_lineage(members.groupBy("node").agg(F.sum("size").alias("mates")))
    involved = members.groupBy("node").agg(F.min("_key").alias("_key"))
    all_texts = df.select(row_key().alias("_key"), whole_text().alias("text"))
    # equal rows have one key: the text is taken once. The plan is the same at every size: the texts are what moves.
    texts = cut_lineage(all_texts.join(cut_lineage(involved).hint("merge"), "_key").groupBy("node").agg(F.first("text").alias("text")))
    members = cut_lineage(members.select("bucket", "node", "n").join(central, "node"))

    left_open = _mixed(members.select("*", F.col("n").alias("shareable"), F.col("node").alias("comp")))
    comps = components(_similar(_star_pairs(left_open, 0), texts))
    for turn in range(1, star_turns + 1):
        left_open = _open(left_open, comps)
        if turn == 1:
            left_open = _mixed(_without_hopeless(left_open, texts))
        if left_open.isEmpty():
            break
        pairs = _star_pairs(left_open, turn) if turn < star_turns else _all_pairs(left_open, texts)
        comps = _merged(comps, _similar(pairs, texts))
    node_class = sketch.select("doc_id", "_key", "node", F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("node")).alias("own"))
    named = node_class.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "own")).select("doc_id", "_key", "comp")
    return cut_lineage(named)


def classes(df: DataFrame, star_turns: int = 2) -> DataFrame:
    """One row per input row: doc_id, _key, class_id (smallest doc_id of the class) and class_size (its rows).

    Two texts are linked from a similarity of 0.8 on; a class is what links connect. Texts with the same words are one
    node. A text of one to four words is one shingle; a text without words (null, empty) is a class of its own rows with
    the same doc_id. A null doc_id never names a class unless no row of it has another. Missed links: a pair at exactly
    0.8 shares no band with a probability of 5 in 100,000. Equal rows get equal results; an empty table gives no rows.
    """
    named = _components_of_rows(df, star_turns)
    names = cut_lineage(named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).filter("class_size > 1"))
    return named.join(names, "comp", "left").select(
        "doc_id", "_key", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay: of each class the row with the smallest doc_id, of several such rows the one with the
    smallest key.

    Rows equal in doc_id and text are one document and leave one row. A class is what links connect, whatever ids its rows
    have: a class without any doc_id keeps its row with the smallest key, and unrelated texts with one doc_id all stay.
    """
    key, copies = fresh(df, "_key", "_copies")
    keyed = _components_of_rows(df).groupBy("_key").agg(
        F.min("doc_id").alias("doc_id"), F.min("comp").alias("comp"), F.count(F.lit(1)).alias("copies")
    )
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_key", "copies")
    first = keyed.groupBy("comp").agg(F.min(order).alias("first"))
    stay = cut_lineage(first.select(F.col("first._key").alias(key), F.col("first.copies").alias(copies)))
    rows = df.withColumn(key, row_key()).join(stay, key)
    once = rows.filter(F.col(copies) == 1)
    again = rows.filter(F.col(copies) > 1).dropDuplicates([key])
    return once.union(again).select(*[F.col(f"`{c}`") for c in df.columns])
