import numpy as np
import pytest

from peakloom.operators import chrom


def direct(y, min_height, share, min_width, x=None):
    """Peaks by the definition, point by point; ``x``: the point numbers, where some are missing."""
    x = x or list(range(len(y)))
    out, n, i = [], len(y), 1
    limit = max(share * (max(y) - min(y)), min_height * 0.1)
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j + 1 < n and y[j + 1] == y[i]:
                j += 1
            if j + 1 < n and y[j + 1] < y[i]:
                p, h = (i + j) // 2, y[i]
                if h >= min_height:
                    l = p
                    low_l = h
                    while l >= 0 and y[l] <= h:
                        low_l, l = min(low_l, y[l]), l - 1
                    r, low_r = p, h
                    while r < n and y[r] <= h:
                        low_r, r = min(low_r, y[r]), r + 1
                    prom = h - max(low_l, low_r)
                    if prom >= limit:
                        level = h - prom * 0.5
                        a = p
                        while y[a] > level:
                            a -= 1
                        left = a + ((level - y[a]) / (y[a + 1] - y[a]) if y[a] < level else 0)
                        b = p
                        while y[b] > level:
                            b += 1
                        right = b - ((level - y[b]) / (y[b - 1] - y[b]) if y[b] < level else 0)
                        if right - left >= min_width:
                            left, right = (x[int(s)] + (s % 1) * (x[min(int(s) + 1, n - 1)] - x[int(s)]) for s in (left, right))
                            top = x[p] if x[j] - x[i] == j - i else x[i]
                            out.append((top, h, prom, left, right))
            i = j + 1
        else:
            i += 1
    return out


@pytest.fixture(scope="module")
def traces():
    rng = np.random.default_rng(7)
    flat = [0, 0, 5, 5, 5, 2, 9, 9, 9, 9, 1, 1, 8, 3, 3, 8, 8]
    smooth = np.round(1000 * np.abs(np.sin(np.arange(150) / 9.0)) * (1 + np.arange(150) / 80.0))
    return {
        "noise": [float(v) for v in rng.integers(0, 30, 120)], "flat": [float(v) for v in flat], "smooth": [float(v) for v in smooth],
        "rise": [float(v) for v in range(40)], "short": [1.0, 9.0, 1.0], "zero": [0.0] * 20,
    }


@pytest.mark.parametrize("chunk", [8, 65536])
def test_find_peaks(spark, traces, chunk):
    rows = [(s, i, i / 100, y) for s, ys in traces.items() for i, y in enumerate(ys)]
    tic = spark.createDataFrame(rows, "sample string, idx int, t double, y double")
    got = chrom.find_peaks(tic, prominence=0.1, min_width=1, min_height=4, chunk=chunk).collect()
    want = {(s, p): rest for s, ys in traces.items() for p, *rest in direct(ys, 4, 0.1, 1)}
    assert {(r["sample"], r["peak_idx"]) for r in got} == set(want)
    for r in got:
        h, prom, left, right = want[(r["sample"], r["peak_idx"])]
        assert (r["height"], r["prominence"]) == (h, prom)
        assert r["left_ip"] == pytest.approx(left) and r["right_ip"] == pytest.approx(right)


@pytest.mark.parametrize("chunk", [8, 65536])
def test_points_without_intensity(spark, traces, chunk):
    rng = np.random.default_rng(8)
    longer = {**traces, "steps": [float(v) for v in np.repeat(rng.integers(0, 12, 60), rng.integers(1, 5, 60))]}
    held = {s: [v if rng.random() > 0.15 else None for v in ys] for s, ys in longer.items()}
    held["steps"][16:33] = [None] * 17  # two chunks of eight without any value
    rows = [(s, i, i / 100, v) for s, ys in held.items() for i, v in enumerate(ys)]
    tic = spark.createDataFrame(rows, "sample string, idx int, t double, y double")
    found = chrom.find_peaks(tic, prominence=0.1, min_width=0, min_height=4, chunk=chunk)
    got = {(r["sample"], r["peak_idx"]): r for r in found.collect()}
    want = {}
    for s, ys in held.items():
        x = [i for i, v in enumerate(ys) if v is not None]
        want |= {(s, p): rest for p, *rest in direct([ys[i] for i in x], 4, 0.1, 0, x)}
    assert set(got) == set(want) and len(want) > 20
    for key, (h, prom, left, right) in want.items():
        r = got[key]
        assert (r["height"], r["prominence"]) == (h, prom)
        assert r["left_ip"] == pytest.approx(left) and r["right_ip"] == pytest.approx(right)
    assert chrom.detect_peaks(tic, 0.1, 0, 4, -1e9, chunk).filter("area is not null and rt is not null").count() == len(want)


def test_one_missing_point_before_a_peak(spark):
    y = [max(0.0, 50.0 - 10 * abs(i - 30)) for i in range(60)]
    rows = [("s", i, i / 10, None if i == 10 else v) for i, v in enumerate(y)]
    tic = spark.createDataFrame(rows, "sample string, idx int, t double, y double")
    [r] = chrom.find_peaks(tic, min_width=1, min_height=10).collect()
    assert (r["peak_idx"], r["left_ip"], r["right_ip"]) == (30, 27.5, 32.5)
    [r] = chrom.detect_peaks(tic, min_width=1, min_height=10, min_area=1).collect()
    assert r["area"] == pytest.approx(25.0) and r["rt"] == 3.0


def test_area_is_above_the_lowest_point_of_the_window(spark):
    y = [2.0, 2, 2, 2, 2, 2, 2, 12, 22, 12, 2, 2, 2, 2, 2, 2, 2]
    tic = spark.createDataFrame([("s", i, i * 0.5, float(v)) for i, v in enumerate(y)], "sample string, idx int, t double, y double")
    r = chrom.detect_peaks(tic, min_width=1, min_height=10, min_area=1).collect()
    assert len(r) == 1
    assert r[0]["area"] == pytest.approx(20.0) and r[0]["rt"] == 4.0 and r[0]["area_pct"] == 100.0 and r[0]["peak_id"] == 1
    assert r[0]["width_50pct"] == pytest.approx(2.0) and r[0]["width_height"] == pytest.approx(12.0)


def test_alignment_labels(spark):
    rows = [("a", 1.00, 5.0), ("b", 1.02, 6.0), ("c", 1.04, 7.0), ("a", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "sample string, rt double, area double")
    got = {(r["sample"], r["rt"]): (r["compound"], r["cluster_id"]) for r in chrom.align_by_rt(df, 0.03).collect()}
    assert got[("a", 1.0)] == got[("c", 1.04)] == ("RT_1.020", 1) and got[("a", 3.0)] == ("RT_3.000", 2)
