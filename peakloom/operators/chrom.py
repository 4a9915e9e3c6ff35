"""Chromatogram operators: peak detection (W3), integration (W4) and alignment across samples.

A trace is cut into chunks of consecutive points. Searches that may run along the whole trace (how far a peak dominates its
surroundings, where it falls to half height) look in their own chunk, pick the one chunk that can hold the answer from
per-chunk extremes, and look there. A trace therefore never has to fit one task.

Points without an intensity are left out; their neighbours become adjacent and keep their point numbers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from peakloom.scale import islands, ordered_totals, small_side
from peakloom.session import cut_lineage

CHUNK = 65536
CELL = 256


def _chunked(tic: DataFrame, chunk: int) -> DataFrame:
    return tic.filter(F.col("y").isNotNull()).select(
        "sample", F.col("idx").cast("long").alias("idx"), "t", "y", F.floor(F.col("idx") / chunk).cast("long").alias("chunk")
    )


def _chunk_table(points: DataFrame) -> DataFrame:
    """One row per chunk with its extremes, its edges, the edges of its neighbours and the number of points before it."""
    edge = F.struct("idx", "t", "y")
    table = points.groupBy("sample", "chunk").agg(
        F.max("y").alias("cmax"), F.min("y").alias("cmin"), F.count(F.lit(1)).alias("n"),
        F.min_by(edge, "idx").alias("first"), F.max_by(edge, "idx").alias("last"),
    )
    along = W.partitionBy("sample").orderBy("chunk")
    seen = F.sum("n").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    return table.select(
        "*", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"), seen.alias("seen")
    )


def _with_neighbours(points: DataFrame, chunks: DataFrame) -> DataFrame:
    along = W.partitionBy("sample", "chunk").orderBy("idx")
    return (
        points.join(chunks.select("sample", "chunk", "before", "after", "seen"), ["sample", "chunk"])
        .select(
            "sample", "chunk", "idx", "t", "y", (F.col("seen") + F.row_number().over(along)).alias("pos"),
            F.coalesce(F.lag("y").over(along), F.col("before.y")).alias("y_prev"),
            F.coalesce(F.lead("y").over(along), F.col("after.y")).alias("y_next"),
            F.coalesce(F.lead("t").over(along), F.col("after.t")).alias("t_next"),
            F.coalesce(F.lead("idx").over(along), F.col("after.idx")).alias("idx_next"),
        )
    )


def local_maxima(tic: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Strict local maxima; a flat top counts once, and a flat stretch at either end does not count.

    The place of a flat top is its middle point, or its first point where points inside it are missing.
    """
    points = _chunked(tic, chunk)
    return _maxima(_with_neighbours(points, _chunk_table(points)), chunk)


def _maxima(points: DataFrame, chunk: int) -> DataFrame:
    flat = F.coalesce(F.col("y_prev") == F.col("y"), F.lit(False)) & F.coalesce(F.col("y_next") == F.col("y"), F.lit(False))
    falls = F.coalesce(F.col("y_next") < F.col("y"), F.lit(False))
    # both ends of a flat run remain here, its inside does not, so the end of a run is the next row
    turns = points.filter(~flat).select(
        "sample", "chunk", "idx", "pos", "y", (F.col("y_prev") < F.col("y")).alias("rises"), falls.alias("falls")
    )
    along = W.partitionBy("sample", "chunk").orderBy("idx")
    turns = turns.withColumn("next", F.lead(F.struct("idx", "falls", "pos")).over(along))
    later = turns.groupBy("sample", "chunk").agg(F.min_by(F.struct("idx", "falls", "pos"), "idx").alias("head"))
    later = later.select("sample", "chunk", F.lead("head").over(W.partitionBy("sample").orderBy("chunk")).alias("head_after"))
    turns = turns.join(later, ["sample", "chunk"]).withColumn("next", F.coalesce("next", "head_after"))
    end = F.when(F.col("falls"), F.struct("idx", "pos")).when(F.col("next.falls"), F.struct("next.idx", "next.pos"))
    whole = end["idx"] - F.col("idx") == end["pos"] - F.col("pos")
    middle = F.when(whole, F.floor((F.col("idx") + end["idx"]) / 2).cast("long")).when(end.isNotNull(), F.col("idx"))
    return (
        turns.filter(F.col("rises")).select("sample", middle.alias("peak_idx"), F.col("y").alias("height"))
        .filter(F.col("peak_idx").isNotNull())
        .withColumn("chunk", F.floor(F.col("peak_idx") / chunk).cast("long"))
    )


def _lows(y: list[float], tops: list[int]) -> tuple[list[float], list[bool]]:
    """For rising positions ``tops``: the lowest value on the way left to the first one above, and whether there is one.

    A stack holds the values that no later one has reached, each with the lowest value since the one below it.
    """
    values, since, lows, bounded = [], [], [], []
    ahead = iter(tops)
    top = next(ahead, -1)
    for i, value in enumerate(y):
        low = value
        while values and values[-1] <= value:
            values.pop()
            low = min(low, since.pop())
        if i == top:
            lows.append(low)
            bounded.append(bool(values))
            top = next(ahead, -1)
        values.append(value)
        since.append(low)
    return lows, bounded


def _falls(y: list[float], tops: list[int], levels: list[float]) -> list[int]:
    """For rising positions ``tops``: the nearest position to the left whose value is not above the level, -1 if none.

    A stack holds the positions that are lower than all after them; their values rise, so the answer is found by halving.
    """
    places, values, out = [], [], []
    ahead = iter(zip(tops, levels))
    top, level = next(ahead, (-1, 0.0))
    for i, value in enumerate(y):
        while values and values[-1] >= value:
            values.pop()
            places.pop()
        values.append(value)
        places.append(i)
        while i == top:
            at = bisect_right(values, level) - 1
            out.append(places[at] if at >= 0 else -1)
            top, level = next(ahead, (-1, 0.0))
    return out


def _crossing(x: float, y: float, inner_x: float, inner_y: float, level: float) -> float:
    """Place between a point below the level and its neighbour towards the peak where the level is met."""
    return x + (inner_x - x) * ((level - y) / (inner_y - y))


def _half_places(x: list[int], y: list[float], tops: list[int], levels: list[float]) -> tuple[list[float | None], list[float | None]]:
    """Where the trace falls to the level on both sides of each top; none if not within these points."""
    last = len(y) - 1
    order = range(len(tops))[::-1]
    left = _falls(y, tops, levels)
    right = [last - p if p >= 0 else -1 for p in _falls(y[::-1], [last - tops[i] for i in order], [levels[i] for i in order])][::-1]

    def place(p: int, inner: int, level: float) -> float | None:
        if p < 0:
            return None
        return _crossing(x[p], y[p], x[inner], y[inner], level) if y[p] < level else float(x[p])

    return [place(p, p + 1, v) for p, v in zip(left, levels)], [place(p, p - 1, v) for p, v in zip(right, levels)]


def _measure_chunk(tops: dict[str, list], x: np.ndarray, y: np.ndarray) -> dict[str, list]:
    """Saddle and half-height places of the peaks of one chunk; a side that leaves the chunk stays open."""
    order = np.argsort(tops["peak_idx"])
    tops = {k: [v[i] for i in order] for k, v in tops.items()}
    places, line = np.searchsorted(x, tops["peak_idx"]).tolist(), y.tolist()
    last = len(line) - 1
    low_l, higher_l = _lows(line, places)
    low_r, higher_r = (v[::-1] for v in _lows(line[::-1], [last - p for p in places[::-1]]))
    open_l = [not (h or first) for h, first in zip(higher_l, tops["is_first"])]
    open_r = [not (h or end) for h, end in zip(higher_r, tops["is_last"])]
    # peaks with an open side get a level that no point meets
    levels = [
        -np.inf if a or b else height - (height - max(l, r)) * 0.5
        for height, l, r, a, b in zip(tops["height"], low_l, low_r, open_l, open_r)
    ]
    left_ip, right_ip = _half_places(x.tolist(), line, places, levels)
    return {
        "peak_idx": tops["peak_idx"], "height": tops["height"], "low_l": low_l, "low_r": low_r, "open_l": open_l, "open_r": open_r,
        "left_ip": left_ip, "right_ip": right_ip,
    }


_MEASURED = (
    "sample string, chunk long, peak_idx long, height double, low_l double, low_r double, open_l boolean, open_r boolean, "
    "left_ip double, right_ip double"
)
_SCANNED = "sample string, chunk long, peak_idx long, side int, place double, low double"


def _enter_chunk(requests: dict[str, list], x: np.ndarray, y: np.ndarray, above: bool) -> dict[str, list]:
    """Walks that enter a chunk at its edge: the running extreme from the edge says where they end."""
    out: dict[str, list] = {c: [] for c in ("peak_idx", "side", "place", "low")}
    prepared = {}
    for side in set(requests["side"]):
        path, at = (y, x) if side > 0 else (y[::-1], x[::-1])
        low = np.minimum.accumulate(path)
        # rises for both: the highest value so far, or how low the lowest value so far is
        prepared[side] = (path, at, low, np.maximum.accumulate(path) if above else -low)
    for peak, side, level, edge_x, edge_y in zip(*[requests[c] for c in ("peak_idx", "side", "level", "edge_x", "edge_y")]):
        path, at, low, extreme = prepared[side]
        stop = int(np.searchsorted(extreme, level, "right") if above else np.searchsorted(extreme, -level, "left"))
        place = None
        if stop < len(path) and not above:
            inner = (edge_x, edge_y) if stop == 0 else (at[stop - 1], path[stop - 1])
            place = float(_crossing(at[stop], path[stop], *inner, level) if path[stop] < level else at[stop])
        for c, v in zip(out, (peak, side, place, float(low[stop - 1]) if stop else np.inf)):
            out[c].append(v)
    return out


def _leave_tops(requests: dict[str, list], x: np.ndarray, y: np.ndarray) -> dict[str, list]:
    """Where a trace falls to the levels of its tops inside their own chunk, both sides of each."""
    order = np.argsort(requests["peak_idx"])
    peaks, levels = ([requests[c][i] for i in order] for c in ("peak_idx", "level"))
    left, right = _half_places(x.tolist(), y.tolist(), np.searchsorted(x, peaks).tolist(), levels)
    n = len(peaks)
    return {"peak_idx": peaks * 2, "side": [-1] * n + [1] * n, "place": left + right, "low": [None] * 2 * n}


def _by_chunk(requests: DataFrame, points: DataFrame, answer, schema: str) -> DataFrame:
    """``answer`` of the requests of each chunk and its points (numbers and intensities, in order).

    Requests and points of a chunk travel as one sorted stream, requests first, so a task handles its chunks one after the
    other without a table per chunk.
    """
    key = ["sample", "chunk"]
    # both sides stem from the same trace; renamed columns keep them apart
    line = points.select(*[F.col(c).alias(c) for c in (*key, "idx", "y")])
    stream = requests.withColumn("_point", F.lit(False)).unionByName(line.withColumn("_point", F.lit(True)), allowMissingColumns=True)
    names = [c for c in requests.columns if c not in key]
    shape = T._parse_datatype_string(schema)
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in shape])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(batch)
            elif not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            sample, chunk, point = (table.column(c).combine_chunks() for c in (*key, "_point"))
            new = pc.or_(pc.not_equal(sample[1:], sample[:-1]), pc.not_equal(chunk[1:], chunk[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            if batch is None:
                starts.append(table.num_rows)
            is_point = point.to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(is_point)])
            idx, y = (table.column(c).to_numpy() for c in ("idx", "y"))
            columns: list[list] = [[] for _ in kinds]
            for a, b in zip(starts, starts[1:]):
                first = b - int(before[b] - before[a])
                if a < first < b:
                    asked = {c: table.column(c)[a:first].to_pylist() for c in names}
                    found = answer(asked, idx[first:b].astype(np.int64), y[first:b])
                    n = len(found["peak_idx"])
                    found |= {"sample": [sample[a].as_py()] * n, "chunk": [chunk[a].as_py()] * n}
                    for c, name in zip(columns, kinds.names):
                        c.extend(found[name])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)
            held = table.slice(starts[-1]).to_batches()

    return stream.repartition(*key).sortWithinPartitions(*key, "_point", "idx").mapInArrow(run, shape)


def _scan(requests: DataFrame, points: DataFrame, answer) -> DataFrame:
    """``answer`` from the chunks that are asked for alone."""
    need = requests.select("sample", "chunk").distinct()
    wanted = points.select(*[F.col(c).alias(c) for c in ("sample", "chunk", "idx", "y")]).join(need, ["sample", "chunk"], "left_semi")
    return _by_chunk(requests, wanted, answer, _SCANNED).drop("chunk")


def _aim(sides: DataFrame, table: DataFrame, above: bool) -> DataFrame:
    """The one other chunk where a walk that left its chunk can end, the lowest value of the chunks crossed on the way there,
    and the point met just before entering it. ``table``: per sample the chunk extremes in order."""
    left = F.col("side") < 0

    def beyond(p: Column) -> Column:
        return F.when(left, p["chunk"] < F.col("chunk")).otherwise(p["chunk"] > F.col("chunk"))

    def able(p: Column) -> Column:
        return p["cmax"] > F.col("level") if above else p["cmin"] <= F.col("level")

    df = sides.join(table, "sample").withColumn("ahead", F.filter("table", beyond))
    hits = F.filter("ahead", able)
    df = df.withColumn("target", F.when(left, F.try_element_at(hits, F.lit(-1))).otherwise(F.try_element_at(hits, F.lit(1)))["chunk"])
    crossed = F.filter(
        "ahead",
        lambda p: F.col("target").isNull() | F.when(left, p["chunk"] > F.col("target")).otherwise(p["chunk"] < F.col("target")),
    )
    # chunks without any intensity are not in the table
    door = F.when(left, F.get(F.filter("table", lambda p: p["chunk"] > F.col("target")), F.lit(0))).otherwise(
        F.try_element_at(F.filter("table", lambda p: p["chunk"] < F.col("target")), F.lit(-1))
    )
    return df.withColumns(
        {
            "low_crossed": F.array_min(F.transform(crossed, lambda p: p["cmin"])),
            "edge_x": F.when(left, door["lo"]["idx"]).otherwise(door["hi"]["idx"]),
            "edge_y": F.when(left, door["lo"]["y"]).otherwise(door["hi"]["y"]),
        }
    ).drop("table", "ahead")


def _settle(open_: DataFrame, points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Finish peaks whose walk leaves their chunk. Peak-sized tables are cut between the steps."""
    need = small_side(open_.select("sample").distinct())
    table = chunks.join(need, "sample", "left_semi").groupBy("sample").agg(
        F.array_sort(
            F.collect_list(F.struct("chunk", "cmax", "cmin", F.col("first").alias("lo"), F.col("last").alias("hi")))
        ).alias("table")
    )
    key = ["sample", "peak_idx", "side"]
    both = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    sides = open_.select("sample", "chunk", "peak_idx", "height", F.col("height").alias("level"), "low_l", "low_r", "open_l", "open_r", both)
    is_left = F.col("side") < 0
    sides = sides.withColumns(
        {"low_own": F.when(is_left, F.col("low_l")).otherwise(F.col("low_r")), "open": F.when(is_left, F.col("open_l")).otherwise(F.col("open_r"))}
    )
    aimed = cut_lineage(_aim(sides.filter("open"), table, above=True))
    there = aimed.filter(F.col("target").isNotNull()).select(
        "sample", F.col("target").alias("chunk"), "peak_idx", "level", "side", "edge_x", "edge_y"
    )
    far = _scan(there, points, partial(_enter_chunk, above=True)).select(*key, F.col("low").alias("low_far"))
    saddles = (
        sides.join(aimed.select(*key, "low_crossed"), key, "left").join(far, key, "left")
        .groupBy("sample", "chunk", "peak_idx", "height")
        .agg(F.max(F.least("low_own", "low_crossed", "low_far")).alias("saddle"))
    )
    levels = cut_lineage(saddles.withColumn("level", F.col("height") - (F.col("height") - F.col("saddle")) * 0.5))
    walks = levels.select("sample", "chunk", "peak_idx", "level", both)
    near = cut_lineage(_scan(levels.select("sample", "chunk", "peak_idx", "level"), points, _leave_tops))
    beyond = _aim(walks.join(near.filter(F.col("place").isNull()).select(*key), key), table, above=False)
    there = beyond.select(
        "sample", F.col("target").alias("chunk"), "peak_idx", "level", "side", "edge_x", "edge_y"
    )
    entered = _scan(there, points, partial(_enter_chunk, above=False))
    places = near.filter(F.col("place").isNotNull()).select(*key, "place").unionByName(entered.select(*key, "place"))
    ips = places.groupBy("sample", "peak_idx").agg(
        F.max(F.when(is_left, F.col("place"))).alias("left_ip"), F.max(F.when(~is_left, F.col("place"))).alias("right_ip")
    )
    return levels.join(ips, ["sample", "peak_idx"]).select("sample", "peak_idx", "height", "saddle", "left_ip", "right_ip")


def find_peaks(
    tic: DataFrame,
    prominence: float = 0.005,
    min_width: float = 5,
    min_height: float = 10000,
    chunk: int = CHUNK,
) -> DataFrame:
    """Peaks by height, prominence and width at half prominence.

    ``tic``: sample, idx (0, 1, ... per sample), t, y. The prominence limit is the larger of a share of the signal range of
    the sample and a tenth of the minimum height. Peaks settled inside their chunk, all of them for traces of one chunk,
    need one pass over the points; the others are few and take the extra steps of ``_settle``.
    """
    points = _chunked(tic, chunk)
    chunks = _chunk_table(points)
    tops = _maxima(_with_neighbours(points, chunks), chunk).filter(F.col("height") >= min_height)
    ends = chunks.select("sample", "chunk", F.col("before").isNull().alias("is_first"), F.col("after").isNull().alias("is_last"))
    local = cut_lineage(_by_chunk(tops.join(ends, ["sample", "chunk"]), points, _measure_chunk, _MEASURED))
    settled = local.filter(F.col("left_ip").isNotNull()).select(
        "sample", "peak_idx", "height", F.greatest("low_l", "low_r").alias("saddle"), "left_ip", "right_ip"
    )
    open_ = local.filter(F.col("left_ip").isNull())
    if not open_.isEmpty():
        settled = settled.unionByName(_settle(open_, points, chunks))
    ranges = points.groupBy("sample").agg((F.max("y") - F.min("y")).alias("range"))
    limit = F.greatest(F.col("range") * float(prominence), F.lit(float(min_height) * 0.1))
    return (
        settled.join(ranges, "sample")
        .withColumn("prominence", F.col("height") - F.col("saddle"))
        .filter(F.col("prominence") >= limit)
        .withColumns(
            {"width_height": F.col("height") - F.col("prominence") * 0.5, "width_50pct": F.col("right_ip") - F.col("left_ip")}
        )
        .filter(F.col("width_50pct") >= min_width)
        .drop("saddle", "range")
    )


def integrate_peaks(tic: DataFrame, peaks: DataFrame, min_area: float = 10000, margin: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Area above the lowest value of the window around each peak, by the trapezoid rule, and its share of the sample.

    The area is the plain trapezoid sum less baseline x width, so one pass over the window suffices. A start or end that
    falls on a point without intensity takes the time of the point before it in the window.
    """
    points = _chunked(tic, chunk)
    points = _with_neighbours(points, _chunk_table(points)).select(
        "sample", "idx", "t", "y", (F.col("t_next") - F.col("t")).alias("dt"), "y_next", "idx_next", F.floor(F.col("idx") / CELL).alias("cell")
    )
    last = points.groupBy("sample").agg(F.max("idx").alias("last_idx"))
    windows = peaks.join(last, "sample").select(
        "sample", "peak_idx",
        F.floor("left_ip").cast("long").alias("li"), F.floor("right_ip").cast("long").alias("ri"),
        F.greatest(F.lit(0), F.floor("left_ip") - margin).cast("long").alias("lo"),
        F.least(F.col("last_idx"), F.floor("right_ip") + margin).cast("long").alias("hi"),
    )
    spread = windows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor(F.col("hi") / CELL))))
    here = F.col("idx")

    def time_at(position: str) -> Column:
        return F.max_by("t", F.when(here <= F.col(position), here))

    sums = (
        spread.join(points, ["sample", "cell"])
        .filter(here.between(F.col("lo"), F.col("hi")))
        .groupBy("sample", "peak_idx")
        .agg(
            F.min("y").alias("baseline"),
            F.sum(F.when(F.col("idx_next") <= F.col("hi"), F.col("dt") * (F.col("y") + F.col("y_next")) / 2)).alias("total"),
            F.min_by("t", here).alias("t_lo"), F.max_by("t", here).alias("t_hi"),
            F.coalesce(time_at("li"), F.min_by("t", here)).alias("rt_start"), time_at("ri").alias("rt_end"),
            time_at("peak_idx").alias("rt"),
        )
        .withColumn("area", F.coalesce("total", F.lit(0.0)) - F.col("baseline") * (F.col("t_hi") - F.col("t_lo")))
    )
    numbered = ordered_totals(peaks.select("sample", "peak_idx", F.lit(1).alias("one")), ["sample"], "peak_idx", ["one"])
    numbered = numbered.select("sample", "peak_idx", (F.col("one_before") + 1).alias("peak_id"))
    out = (
        peaks.join(sums, ["sample", "peak_idx"]).join(numbered, ["sample", "peak_idx"])
        .select(
            "sample", "peak_id", F.round("rt", 4).alias("rt"), F.round("rt_start", 4).alias("rt_start"),
            F.round("rt_end", 4).alias("rt_end"), F.round("height", 1).alias("height"), F.round("area", 1).alias("area"),
            "width_50pct", "width_height", F.round("prominence", 1).alias("prominence"),
        )
        .filter(F.col("area") >= min_area)
    )
    totals = out.groupBy("sample").agg(F.sum("area").alias("sample_area"))
    share = F.coalesce(F.try_divide("area", "sample_area") * 100, F.lit(0.0))
    return out.join(totals, "sample").withColumn("area_pct", F.round(share, 2)).drop("sample_area")


def detect_peaks(
    tic: DataFrame,
    prominence: float = 0.005,
    min_width: float = 5,
    min_height: float = 10000,
    min_area: float = 10000,
    chunk: int = CHUNK,
) -> DataFrame:
    """W3 and W4 together: the peak table of every trace."""
    # one row per peak, read three times by the integration
    found = cut_lineage(find_peaks(tic, prominence, min_width, min_height, chunk))
    return integrate_peaks(tic, found, min_area, chunk=chunk)


def align_by_rt(peaks: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Peaks of all samples whose times chain within the tolerance form one compound, labelled by their mean time."""
    counts = peaks.groupBy("rt").agg(F.count(F.lit(1)).alias("n"))
    members = islands(counts, "rt", tolerance).join(counts, "rt")
    centres = members.groupBy("island").agg(F.round(F.sum(F.col("rt") * F.col("n")) / F.sum("n"), 4).alias("consensus_rt"))
    labels = members.join(centres, "island").select(
        "rt", F.col("island").cast("long").alias("cluster_id"), "consensus_rt",
        F.format_string("RT_%.3f", "consensus_rt").alias("compound"),
    )
    return peaks.drop("compound").join(small_side(labels, proof=counts), "rt")
