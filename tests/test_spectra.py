import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import identify, ionmatch, spectra

Q = "query_id int, peaks array<struct<mz:double,intensity:int>>, ri_expected double"
L = "lib_id long, name string, ri_exp double, source string, compound_class string, class_confidence double, peaks array<struct<mz:double,intensity:int>>"


def ion_match(query, ref, tolerance=0.5):
    """Direct reading of the definition: each reference ion takes its nearest query ion, the first on ties."""
    mz = np.array([m for m, _ in query])
    dot = matched = 0
    for m, i in ref:
        gaps = np.abs(mz - m)
        at = int(np.argmin(gaps))
        if gaps[at] <= tolerance:
            dot, matched = dot + i * query[at][1], matched + 1
    return dot, matched


def factor(x):
    return min(999, max(0, int(x * 999)))


def scores(query, ref):
    dot, matched = ion_match(query, ref)
    back, matched_q = ion_match(ref, query)
    qs, rs = sum(i * i for _, i in query), sum(i * i for _, i in ref)
    cos = dot / np.sqrt(rs * qs)
    fwd = factor(0.8 * cos + 0.2 * matched_q / len(query))
    rev = factor(0.7 * dot / rs + 0.3 * matched / len(ref))
    return {
        "cosine": factor(cos), "forward": fwd, "reverse": rev, "hybrid": factor(0.6 * (fwd / 999.0) + (1 - 0.6) * (rev / 999.0)),
        "manager": (factor(cos), factor(back / np.sqrt(rs * qs))),
    }


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)

    def spectrum():
        n = int(rng.integers(3, 9))
        return [(float(m), int(i)) for m, i in zip(np.round(rng.uniform(40, 52, n), 1), rng.integers(1, 1000, n))]

    queries = [(i, spectrum(), None) for i in range(12)]
    library = [(i, f"c{i}", None, "msp_file", None, None, spectrum()) for i in range(15)]
    # a query far from every base peak but sharing a weak ion
    queries.append((90, [(200.0, 999), (300.0, 500), (45.0, 10)], None))
    return queries, library, spark.createDataFrame(queries, Q).cache(), spark.createDataFrame(library, L).cache()


@pytest.mark.parametrize("mode", ["cosine", "forward", "reverse", "hybrid"])
def test_modes_equal_brute_force(data, mode):
    queries, library, q, lib = data
    got = {(r["query_id"], r["lib_id"]): r["match_factor"] for r in spectra.search(q, lib, mode=mode, min_match=1).collect()}
    want = {}
    for qid, qp, _ in queries:
        for row in library:
            s = scores(qp, row[6])[mode]
            if s >= 1:
                want[(qid, row[0])] = s
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) <= 1 for k in want)
    assert sum(got[k] != want[k] for k in want) <= 1


def test_small_blocks_give_the_same(data):
    _, _, q, lib = data
    a = spectra.search(q, lib, min_match=1).orderBy("query_id", "rank").collect()
    b = spectra.search(q, lib, min_match=1, block_ions=20).orderBy("query_id", "rank").collect()
    assert a == b


def test_manager_equals_brute_force(data):
    queries, library, q, lib = data
    got = {(r["query_id"], r["lib_id"]): (r["match_forward"], r["match_reverse"], r["match_factor"])
           for r in spectra.search_manager(q, lib, min_match=1, k=None).collect()}
    base = {row[0]: int(max(row[6], key=lambda p: p[1])[0]) for row in library}
    want = {}
    for qid, qp, _ in queries:
        top = {int(m) for m, _ in sorted(qp, key=lambda p: p[1], reverse=True)[:5]}
        cand = [i for i, b in base.items() if any(abs(b - t) <= 1 for t in top)] or list(base)
        for row in library:
            if row[0] in cand:
                f, r = scores(qp, row[6])["manager"]
                mf = (f + r) // 2
                mf = min(mf, 500) if f < 400 or r < 400 else mf
                if mf >= 1:
                    want[(qid, row[0])] = (f, r, mf)
    assert got == want


def test_identical_spectrum_scores_999_and_reuse_is_clamped(spark):
    p = [(41.0, 300), (43.0, 999), (57.0, 500)]
    q = spark.createDataFrame([(1, p, None), (2, [(50.25, 999)], None)], Q)
    lib = spark.createDataFrame([(1, "same", None, "x", None, None, p), (2, "twin", None, "x", None, None, [(50.0, 999), (50.5, 999)])], L)
    got = {(r["query_id"], r["lib_id"]): r["match_factor"] for r in spectra.search(q, lib, mode="cosine").collect()}
    assert got == {(1, 1): 999, (2, 2): 999}


def hits_for(spark, entries, ri):
    p = [(41.0, 300), (43.0, 999), (57.0, 500)]
    q = spark.createDataFrame([(1, p, ri)], Q)
    lib = spark.createDataFrame([(i, f"n{i}", r, "x", c, conf, peaks) for i, (r, c, conf, peaks) in enumerate(entries)], L)
    return q, lib, p


def test_promotion_of_index_backed_hits(spark):
    near = [(41.0, 300), (43.0, 999), (57.0, 250)]
    for ri_exp, first in ((1000.0, 1), (1080.0, 0), (None, 0)):
        q, lib, p = hits_for(spark, [(None, None, None, [(41.0, 300), (43.0, 999), (57.0, 500)]), (ri_exp, None, None, near)], 1000.0)
        rows = spectra.search(q, lib, min_match=500).orderBy("rank").collect()
        assert rows[0]["lib_id"] == first, (ri_exp, rows)


def test_penalty_and_class_factor(spark):
    values = [(1000.0, 1.0), (1050.0, 1.0), (1075.0, 0.75), (1100.0, 0.5), (1150.0, 0.3), (1200.0, 0.1), (1500.0, 0.1), (None, 1.0)]
    df = spark.createDataFrame([(v[0], v[1]) for v in values], "lib double, want double").withColumn("exp", F.lit(1000.0))
    for r in df.select("want", spectra.ri_penalty(F.col("lib"), F.col("exp")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"])
    rows = [("food_flavor", 1.0, 1.2), ("natural_product", 0.5, 1.1), ("pharmaceutical", 2.0, 0.7), ("industrial", 0.0, 0.75), ("other", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "c string, conf double, want double")
    for r in df.select("want", spectra.class_factor(F.col("c"), F.col("conf")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_combined_score_thresholds(spark):
    cases = [
        (700, 1009.0, 950, "confirmed"), (700, 1010.0, 880, "high"), (720, 1019.0, 900, "confirmed"), (700, 1034.0, 800, "high"),
        (700, 1049.0, 740, "probable"), (700, 1099.0, 650, "tentative"), (700, 1100.0, 550, "low"), (100, 1500.0, 0, "unreliable"),
        (900, None, 900, "high"), (599, None, 599, "unreliable"), (990, 1001.0, 999, "confirmed"),
    ]
    df = spark.createDataFrame([(m, e, s, c) for m, e, s, c in cases], "ms int, expected double, score int, conf string")
    out = df.withColumns(identify.combined_columns(F.col("ms"), F.lit(1000.0), F.col("expected"))).collect()
    for r in out:
        assert (r["combined_score"], r["confidence"]) == (r["score"], r["conf"])


def test_rt_gate(spark):
    hits = spark.createDataFrame(
        [
            (1, 1, 10, 650, 5.0), (1, 2, 11, 640, 14.0),     # first too far at 2.5, second within 3.5
            (2, 1, 10, 960, 5.0),                            # 950 widens to 10
            (3, 1, 10, 650, None), (3, 2, 11, 640, 14.0),    # no expected time passes when first
            (4, 1, 10, 650, 5.0), (4, 2, 11, 640, None),     # an alternative needs a time
        ], "query_id int, rank int, lib_id long, match_factor int, rt_exp double")
    times = spark.createDataFrame([(1, 12.0), (2, 14.5), (3, 12.0), (4, 12.0)], "query_id int, rt double")
    got = {r["query_id"]: r["lib_id"] for r in identify.gate_by_rt(hits, times).collect()}
    assert got == {1: 11, 2: 10, 3: 10}
    strict = {r["query_id"]: r["lib_id"] for r in identify.gate_by_rt(hits, times, "manager").collect()}
    assert strict == {1: 11, 3: 10}


def test_min_match_below_one_is_refused(data):
    with pytest.raises(ValueError):
        spectra.search(data[2], data[3], min_match=0)


def _random_spectra(rng, n, whole, key):
    out = []
    for i in range(n):
        mz = 40 + np.arange(30) + (0 if whole else rng.integers(-300, 300, 30) / 1000)
        out.append({key: i, "peaks": [(float(m), int(x)) for m, x in zip(mz, rng.integers(0, 999, 30)) if x > 200]})
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_first_hits_are_those_of_the_whole_ranking_and_few_pairs_leave_a_block(spark, whole):
    rng = np.random.default_rng(5)
    peaks = "peaks array<struct<mz:double,intensity:int>>"
    lib = [
        {**s, "name": f"n{s['lib_id']}", "ri_exp": None if s["lib_id"] % 3 else 800.0 + s["lib_id"], "compound_class": "food_flavor" if s["lib_id"] % 2 else "industrial",
         "class_confidence": 0.5} for s in _random_spectra(rng, 150, whole, "lib_id")
    ]
    lib = spark.createDataFrame(lib, f"lib_id long, {peaks}, name string, ri_exp double, compound_class string, class_confidence double")
    queries = [{**s, "ri_expected": 900.0 if s["query_id"] % 4 else None} for s in _random_spectra(rng, 25, whole, "query_id")]
    queries = spark.createDataFrame(queries, f"query_id long, {peaks}, ri_expected double")
    for boost in (False, True):
        options = dict(min_match=400, category_boost=boost, block_ions=1_000)
        everything = {tuple(r) for r in spectra.search(queries, lib, **options).filter("rank <= 2").collect()}
        assert {tuple(r) for r in spectra.search(queries, lib, k=2, **options).collect()} == everything and everything
    for both in (True, False):
        options = dict(min_match=300, require_both=both, block_ions=1_000)
        everything = {tuple(r) for r in spectra.search_manager(queries, lib, k=None, **options).filter("rank <= 2").collect()}
        assert {tuple(r) for r in spectra.search_manager(queries, lib, k=2, **options).collect()} == everything and everything
    block, entries = queries.toArrow(), spectra.prepare_library(lib).withColumn("factor", F.lit(1.0)).toArrow()
    found = lambda leaders: sum(len(e) for _, e, _ in ionmatch.pairs(entries, block, "cosine", 300.0, 0.5, False, False, leaders))
    assert found(ionmatch.Leaders(2, 300, by_index=True, backed=True)) < found(None) / 4
