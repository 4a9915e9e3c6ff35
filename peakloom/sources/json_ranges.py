"""Items of large JSON documents, read by many tasks: one document is cut into blocks of bytes.

Whether a block begins inside a string, and how deep, follows from all blocks before it. A first pass sums up each block
for every way it can begin; windows over these narrow rows say how each does begin; a second pass then finds the items of
the outermost list or map that start in a block, and reads on for the last one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

BLOCK = 32 << 20
#: Stores that tasks open themselves; documents elsewhere are read by Spark as a whole.
SCHEMES = ("file:", "hdfs:", "s3:", "gs:", "abfs:", "abfss:")

QUOTE, SLASH, COMMA = 34, 92, 44
OPEN, CLOSE = (91, 123), (93, 125)


def reachable(path: str) -> bool:
    return path.startswith(SCHEMES)


def _read(path: str, start: int, length: int) -> np.ndarray:
    system, place = (pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else pafs.FileSystem.from_uri(path)
    with system.open_input_file(place) as file:
        return np.frombuffer(file.read_at(length, start), np.uint8)


def _quotes(data: np.ndarray, escaped: int) -> tuple[np.ndarray, int]:
    """Which bytes begin or end a string, and whether the byte after the block is escaped. ``escaped``: the first byte is."""
    n = len(data)
    index = np.arange(n)
    plain = np.maximum.accumulate(np.where(data != SLASH, index, -1))
    # backslashes right before each byte, and before the one after the block
    before = np.arange(n + 1) - 1 - np.concatenate([[-1], plain])
    odd = (before + np.where(before == np.arange(n + 1), escaped, 0)) % 2
    return (data == QUOTE) & (odd[:n] == 0), int(odd[n])


def _steps(data: np.ndarray, quotes: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of depth at each byte, and which bytes lie outside of strings."""
    outside = (np.cumsum(quotes) - quotes + inside) % 2 == 0
    steps = np.isin(data, OPEN).astype(np.int64) - np.isin(data, CLOSE)
    return np.where(outside, steps, 0), outside


_SUMMARY = "path string, length long, start long, t0 int, t1 int, p0 int, p1 int, d00 long, d01 long, d10 long, d11 long"


def _summaries(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, length, start in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "start")]):
            data = _read(path, start, min(block, length - start))
            quotes, trail = zip(*[_quotes(data, e) for e in (0, 1)])
            depth = [int(_steps(data, q, i)[0].sum()) for q in quotes for i in (0, 1)]
            rows.append((path, length, start, *trail, *[int(q.sum() % 2) for q in quotes], *depth))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 4]
            names = ["path", "length", "start", "t0", "t1", "p0", "p1", "d00", "d01", "d10", "d11"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _cuts(data: np.ndarray, escaped: int, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Positions after which items begin, positions before which they end, and the state after the block."""
    quotes, trail = _quotes(data, escaped)
    steps, outside = _steps(data, quotes, inside)
    level = depth + np.cumsum(steps) - steps
    comma = outside & (data == COMMA) & (level == 1)
    begins = comma | ((steps > 0) & (level == 0))
    ends = comma | ((steps < 0) & (level == 1))
    return np.flatnonzero(begins) + 1, np.flatnonzero(ends), (trail, int((quotes.sum() + inside) % 2), int(depth + steps.sum()))


def _items(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length, start, *state in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "start", "escaped", "inside", "depth")]):
            data = _read(path, start, min(block, length - start))
            begins, ends, after = _cuts(data, *state)
            raw = data.tobytes()
            # the last item may go on in the blocks that follow
            at = start + len(raw)
            stops = ends.tolist()
            while len(begins) and (not stops or stops[-1] < begins[-1]) and at < length:
                more = _read(path, at, min(block, length - at))
                _, found, after = _cuts(more, *after)
                stops += [at - start + int(x) for x in found[:1]]
                raw += more.tobytes()
                at += len(more)
            place = np.searchsorted(stops, begins)
            texts = [raw[a : stops[k]].strip() if k < len(stops) else b"" for a, k in zip(begins.tolist(), place.tolist())]
            kept = [(n, t.decode("utf-8", "replace")) for n, t in enumerate(texts) if t]
            if kept:
                rows, values = zip(*kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows)), pa.array([start] * len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.array(values)],
                    ["path", "split", "row", "text"],
                )


def json_items(spark: SparkSession, paths: str | Sequence[str], block: int = BLOCK) -> DataFrame:
    """Items of the outermost list (or members of the outermost map, as ``"key": value``) of each document: path, split and
    row (which order the items of a document), text.

    An item longer than a block is read by the task that it begins in. Space between items and an empty list give nothing.
    """
    listing = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long")))
    blocks = listing.filter("length > 0").select("path", "length", starts.alias("start"))
    # tiny rows that stand for megabytes: a stated number of partitions keeps them apart
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summaries(batches, block)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _items(batches, block)

    known = blocks.repartition(parts, "path", "start").mapInArrow(summarised, _SUMMARY)
    order = W.partitionBy("path").orderBy("start")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    begun = known.withColumn("escaped", F.coalesce(F.lag("t0").over(order), F.lit(0)))
    pick = lambda a, b, which: F.when(F.col(which) == 0, F.col(a)).otherwise(F.col(b))
    begun = begun.withColumns({"parity": pick("p0", "p1", "escaped"), "d_out": pick("d00", "d10", "escaped"), "d_in": pick("d01", "d11", "escaped")})
    begun = begun.withColumn("inside", F.pmod(F.coalesce(F.sum("parity").over(earlier), F.lit(0)), F.lit(2)).cast("int"))
    begun = begun.withColumn("delta", pick("d_out", "d_in", "inside"))
    begun = begun.withColumn("depth", F.coalesce(F.sum("delta").over(earlier), F.lit(0)).cast("long"))
    state = begun.select("path", "length", "start", "escaped", "inside", "depth").repartition(parts, "path", "start")
    return state.mapInArrow(found, "path string, split long, row long, text string")
