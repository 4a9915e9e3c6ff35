"""Building blocks that keep joins, ranks and quantiles balanced when one key holds a large share of the rows.

Nothing here samples or caps: every helper returns the exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SMALL_ROWS = 500_000
BUCKETS_PER_OCTAVE = 256


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS, proof: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast only when a bounded count proves the side small.

    ``proof`` is a cheaper frame with the same number of rows, such as the distinct keys of an aggregation: counting it
    reads the key columns only. Above the bound the frame comes back unhinted, so the join shuffles and adaptive
    execution splits its hot keys.
    """
    return F.broadcast(df) if is_small(df if proof is None else proof, max_rows) else df


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def order_bucket(value: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """Bucket number that never decreases with the value.

    A pure expression of the value (log scale on both sides of zero): a recomputed task always agrees with the
    first attempt, which boundaries taken from a sketch would not guarantee.
    """
    v = value.cast("double")
    scaled = F.floor(F.log2(F.abs(v)) * per_octave) + F.lit(1100 * per_octave)
    return F.when(v > 0, scaled).when(v < 0, -scaled).otherwise(F.lit(0)).cast("long")


def ordered_totals(df: DataFrame, keys: Sequence[str], order_col: str, sums: Sequence[str]) -> DataFrame:
    """Running totals over ``order_col`` inside each key, in two levels.

    ``df`` holds one row per (keys, order_col). For every column s in ``sums`` the result adds ``s_before`` (total of
    the smaller values) and ``s_total`` (total of the key). A key is cut into value buckets: each task sorts one bucket,
    and only the per-bucket totals, whose number depends on the value range and not on the row count, are ordered together.
    """
    keys = list(keys)
    d = df.withColumn("_bucket", order_bucket(F.col(order_col)))
    per_bucket = d.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order_col).rowsBetween(W.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums])
    out = d.join(offsets, [*keys, "_bucket"])
    for s in sums:
        out = out.withColumn(f"{s}_before", F.col(f"_in_{s}") + F.col(f"_off_{s}"))
    return out.drop("_bucket", *[f"_in_{s}" for s in sums], *[f"_off_{s}" for s in sums])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key: one column per entry of ``probs``.

    Values are counted before they are ordered, and ordered by ``ordered_totals``, so a hot key is spread over tasks;
    the built-in ``percentile`` would keep all distinct values of a key in one buffer.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_totals(counts, keys, value, ["n"])

    def at(rank: Column) -> Column:
        covers = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(covers, F.col(value)))

    picks = [F.max("n_total").alias("_n")]
    for name, p in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(p))
        picks += [at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}")]
    grouped = ranked.groupBy(*keys).agg(*picks) if keys else ranked.agg(*picks)
    position = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    return grouped.select(
        *keys,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (position[name] - F.floor(position[name]))
            ).alias(name)
            for name in probs
        ],
    )


def near_join(
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    right_value: str,
    tolerance: float,
    keys: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Pairs with ``abs(left_value - right_value) <= tolerance`` (``<`` when strict) as an equi-join on value buckets.

    Only the right side is repeated, over the two or three buckets its interval touches, so no pair appears twice.
    Columns other than the keys must differ between the sides.
    """
    width = float(tolerance) if tolerance > 0 else 1.0
    slack = 1e-9 * max(1.0, width)
    lo = F.floor((F.col(right_value) - F.lit(tolerance + slack)) / width)
    hi = F.floor((F.col(right_value) + F.lit(tolerance + slack)) / width)
    left_b = left.withColumn("_cell", F.floor(F.col(left_value) / width))
    right_b = right.filter(F.col(right_value).isNotNull()).withColumn("_cell", F.explode(F.sequence(lo, hi)))
    gap = F.abs(F.col(left_value) - F.col(right_value))
    test = gap < F.lit(tolerance) if strict else gap <= F.lit(tolerance)
    return left_b.join(right_b, [*keys, "_cell"]).filter(test).drop("_cell")


def nearest_within(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, keys: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """For each row of ``left``, the smallest distance to a value of ``right`` within the tolerance, and the value before
    and after it at this distance: ``left`` with ``_gap``, ``_below`` and ``_above`` (null if that side is farther).

    Values are ordered together inside cells of some tolerances, and a value of the right side near the edge of its cell
    stands in the next one too: no pairs are formed, however densely the values lie, and each side is dealt once. Either
    side may repeat values and carry other columns.
    """
    keys = list(keys)
    width = F.lit(8 * float(tolerance) if tolerance > 0 else 1.0)
    known = lambda side, c: side.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).dropna(subset=keys or None, how="any" if keys else "all")
    left, right = known(left, left_value), known(right, right_value)
    mine = left.select("*", F.col(left_value).cast("double").alias("_x"), F.lit(None).cast("double").alias("_point"))
    mine = mine.withColumn("_cell", F.floor(F.col("_x") / width))
    theirs = right.select(*keys, F.col(right_value).cast("double").alias("_x")).filter(F.abs("_x") < float("inf"))
    # rounding may move a value at the very edge
    reach = F.lit(tolerance * 1.000001) + F.abs("_x") * 1e-15
    # a cell is wider than the reach to both sides, so a value stands in two cells at most
    cells = F.array_distinct(F.array(*[F.floor(x / width) for x in (F.col("_x") - reach, F.col("_x"), F.col("_x") + reach)]))
    theirs = theirs.select("*", F.col("_x").alias("_point"), F.explode(cells).alias("_cell"))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    nearest = lambda order: F.last("_point", True).over(W.partitionBy(*keys, "_cell").orderBy(order).rangeBetween(W.unboundedPreceding, 0))
    found = both.select("*", nearest(F.asc("_x")).alias("_below"), nearest(F.desc("_x")).alias("_above")).filter(F.col("_point").isNull())
    down, up = F.abs(F.col("_x") - F.col("_below")), F.abs(F.col("_x") - F.col("_above"))
    found = found.withColumn("_gap", F.least(down, up))
    test = F.col("_gap") < F.lit(tolerance) if strict else F.col("_gap") <= F.lit(tolerance)
    return found.filter(test).select(
        *left.columns, "_gap", F.when(down == F.col("_gap"), F.col("_below")).alias("_below"),
        F.when(up == F.col("_gap"), F.col("_above")).alias("_above"),
    )


def islands(df: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Single-linkage groups of a column of distinct values: a new group starts where the gap exceeds the tolerance.

    Returns (value, island) with island numbered from 1. Gaps are looked up inside value buckets; the first value of a
    bucket is compared with the largest value of the buckets before it, one row per bucket.
    """
    d = df.select(value, order_bucket(F.col(value)).alias("_bucket"))
    inside = W.partitionBy("_bucket").orderBy(value)
    d = d.withColumn("_prev", F.lag(value).over(inside))
    edges = d.groupBy("_bucket").agg(F.max(value).alias("_hi"))
    edges = edges.select(
        "_bucket", F.lag("_hi").over(W.partitionBy(F.lit(0)).orderBy("_bucket")).alias("_prev_hi")
    )
    d = d.join(edges, "_bucket").withColumn("_prev", F.coalesce("_prev", "_prev_hi"))
    # A start is marked once per island, so the running total of starts numbers the islands.
    d = d.select(
        value,
        F.when(F.col("_prev").isNull() | (F.col(value) - F.col("_prev") > F.lit(tolerance)), 1).otherwise(0).alias("start"),
    )
    return ordered_totals(d, [], value, ["start"]).select(
        value, (F.col("start_before") + F.col("start")).alias("island")
    )
