import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators.compare import adjust_fdr
from peakloom.operators.rtmatch import match_rt_library, nearest_scans
from peakloom.scale import is_small, islands, near_join, nearest_within, order_bucket, ordered_totals, quantiles


def test_quantiles_match_numpy_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in np.round(rng.lognormal(0, 2, 3000), 3)]
    rows += [("neg", float(x)) for x in rng.normal(0, 5, 101)] + [("one", 4.0), ("ties", 1.0), ("ties", 1.0), ("ties", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for key in ("hot", "neg", "one", "ties"):
        values = [v for k, v in rows if k == key]
        for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
            assert got[key][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_order_bucket_never_decreases(spark):
    values = sorted([-1e9, -3.5, -1.0, -1e-9, 0.0, 1e-300, 1e-9, 0.5, 0.999999, 1.0, 1.0000001, 7.0, 1e12])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(order_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


def test_ordered_totals(spark):
    rows = [("a", float(v), v) for v in range(1, 50)] + [("b", 2.0, 5)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    for r in ordered_totals(df, ["k"], "v", ["n"]).collect():
        same = [n for k, v, n in rows if k == r["k"]]
        assert r["n_before"] == sum(n for k, v, n in rows if k == r["k"] and v < r["v"]) and r["n_total"] == sum(same)


def test_near_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.uniform(0, 5, 200), 2), np.round(rng.uniform(0, 5, 150), 2)
    left = spark.createDataFrame([(float(x),) for x in sorted(set(a))], "x double")
    right = spark.createDataFrame([(float(y),) for y in sorted(set(b))], "y double")
    for strict in (False, True):
        got = {(r["x"], r["y"]) for r in near_join(left, right, "x", "y", 0.25, strict=strict).collect()}
        want = {(x, y) for x in set(a) for y in set(b) if (abs(x - y) < 0.25 if strict else abs(x - y) <= 0.25)}
        assert got == want


def test_islands(spark):
    # the chain 1.0, 1.5, 2.0 is one island although its ends are further apart than the gap allows
    df = spark.createDataFrame([(v,) for v in (1.0, 1.5, 2.0, 2.75, 40.0, 40.5)], "v double")
    got = {r["v"]: r["island"] for r in islands(df, "v", 0.5).collect()}
    assert got == {1.0: 1, 1.5: 1, 2.0: 1, 2.75: 2, 40.0: 3, 40.5: 3}


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.9, 0.005]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = [r["q"] for r in adjust_fdr(df, "p", "q").orderBy("i").collect()]
    order, n, want, low = np.argsort(p, kind="stable"), len(p), [0.0] * len(p), 1.0
    for rank in range(n, 0, -1):
        low = min(low, p[order[rank - 1]] * n / rank)
        want[order[rank - 1]] = low
    assert got == pytest.approx(want)
    assert all(q >= v for q, v in zip(got, p))
    one = spark.createDataFrame([(0, 0.2)], "i int, p double")
    assert adjust_fdr(one, "p", "q").first()["q"] == pytest.approx(0.2)


def test_nearest_scans_bridges_empty_cells(spark):
    rng = np.random.default_rng(3)
    peaks = [("s", round(float(x), 3)) for x in rng.uniform(0, 30, 80)] + [("none", 1.0)]
    scans = [("s", round(float(x), 3)) for x in np.concatenate([rng.uniform(2, 3, 10), rng.uniform(20, 21, 10)])]
    got = {
        r["rt"]: r["scan_rt"]
        for r in nearest_scans(spark.createDataFrame(peaks, "sample string, rt double"), spark.createDataFrame(scans, "sample string, scan_rt double")).collect()
    }
    assert set(got) == {rt for s, rt in peaks if s == "s"}
    for rt, scan in got.items():
        assert abs(scan - rt) == pytest.approx(min(abs(s - rt) for _, s in scans))


def test_size_check(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)


@pytest.mark.parametrize("strict", [True, False])
def test_nearest_within_equals_brute_force_with_repeats_and_nulls(spark, strict):
    rng = np.random.default_rng(8)
    a = [(k, float(x)) for k in "pq" for x in np.unique(np.round(rng.uniform(-2, 5, 120), 2))] + [("p", None), (None, 1.0)]
    b = [(k, float(x)) for k in "pq" for x in np.round(rng.uniform(-2, 5, 60), 2)] * 2 + [("q", None), (None, 1.0), ("p", float("nan"))]
    left, right = spark.createDataFrame(a, "k string, x double"), spark.createDataFrame(b, "k string, y double")
    got = {(r["k"], r["x"]): (r["_gap"], r["_below"], r["_above"]) for r in nearest_within(left, right, "x", "y", 0.05, ["k"], strict).collect()}
    want = {}
    for k, x in a:
        near = [y for j, y in b if k and j == k and x is not None and y is not None and (abs(x - y) < 0.05 if strict else abs(x - y) <= 0.05)]
        if near:
            gap = min(abs(x - y) for y in near)
            want[k, x] = gap, max((y for y in near if x - y == gap), default=None), min((y for y in near if y - x == gap), default=None)
    assert got == want and want


def test_a_dense_library_forms_no_pairs(spark):
    # 3,000 times and 3,000 entries within the tolerance of one another: 9 million pairs
    times = spark.range(3000).select((F.lit(5.0) + F.col("id") / 100_000).alias("rt"), F.lit("RT_x").alias("compound"))
    library = spark.range(3000).select(F.col("id").cast("int").alias("ord"), F.col("id").cast("string").alias("name"), F.lit("c").alias("cat"), (F.lit(5.0) + F.col("id") / 100_000).alias("rt_est"))
    matched = match_rt_library(times, library)
    assert matched.filter("rt_diff = 0").count() == 3000
    assert "rt_est >=" not in (plan := matched._jdf.queryExecution().optimizedPlan().toString()) and "<= 0.3" in plan and "explode(sequence" not in plan


@pytest.mark.parametrize("tolerance, strict", [(0.5, False), (0.5, True), (0.0, False)])
def test_nearest_value_of_rows_that_repeat_and_carry_columns(spark, tolerance, strict):
    """both sides are dealt once, as they are, and each row of the left side finds its nearest values."""
    rng = np.random.default_rng(6)
    values = lambda n: [*np.round(rng.uniform(-9, 9, n), 1).tolist(), 4.0, 4.0, float("inf"), float("-inf"), float("nan"), None]
    left = [(k, x, f"n{i}") for i, (k, x) in enumerate((k, x) for k in ("a", "b", None) for x in values(60))]
    right = [(k, x, "other") for k in ("a", "b", None) for x in values(25)]
    found = nearest_within(
        spark.createDataFrame(left, "k string, x double, name string"), spark.createDataFrame(right, "k string, y double, z string"),
        "x", "y", tolerance, keys=["k"], strict=strict,
    )
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    want = set()
    for k, x, name in left:
        near = [y for j, y, _ in right if k is not None and j == k and None not in (x, y) and abs(x - y) <= tolerance]
        if near and (gap := min(abs(x - y) for y in near)) < tolerance + (not strict):
            want.add((name, gap, max((y for y in near if y <= x and x - y == gap), default=None), min((y for y in near if y >= x and y - x == gap), default=None)))
    assert {(r["name"], r["_gap"], r["_below"], r["_above"]) for r in found.collect()} == want and want
