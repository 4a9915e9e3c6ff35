import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakloom.functions.pvalues import mann_whitney_p, student_p
from peakloom.operators import compare, correlation, enrichment, filters, kovats, library as lib_ops, rtmatch, samples, stats

PEAKS = "grp string, sample string, compound string, rt double, area double, conc double"


def test_p_values(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (-2.0, 10.0), (2.228138852, 10.0), (1.96, 1e7)], "t double, df double")
    got = [r[0] for r in df.select(student_p("t", "df")).collect()]
    assert got == pytest.approx([0.073388035, 1.0, 0.073388035, 0.05, 0.0499958], abs=2e-7)
    # complete separation of 3 and 3 values: 2 of 20 orders; equal counts around the middle give 1
    df = spark.createDataFrame([(0.0, 3, 3, 0.0), (9.0, 3, 3, 0.0), (4.5, 3, 3, 0.0), (8.0, 4, 4, 6.0)], "u double, a long, b long, tie double")
    got = [r[0] for r in df.select(mann_whitney_p("u", "a", "b", "tie")).collect()]
    assert got[:2] == pytest.approx([0.1, 0.1]) and got[2] == 1.0 and got[3] == 1.0


def test_constant_groups(spark):
    rows = [("A", f"s{i}", "same", 1.0, 1.0, 2.0) for i in range(3)] + [("B", f"t{i}", "same", 1.0, 1.0, 2.0) for i in range(3)]
    rows += [("A", f"s{i}", "apart", 1.0, 1.0, 2.0) for i in range(3)] + [("B", f"t{i}", "apart", 1.0, 1.0, 3.0) for i in range(3)]
    rows += [("A", "s0", "single", 1.0, 1.0, 2.0), ("B", "t0", "single", 1.0, 1.0, 2.0)]
    got = {r["compound"]: r for r in compare.compare_groups(spark.createDataFrame(rows, PEAKS), "A", "B").collect()}
    assert set(got) == {"same", "apart"}
    assert got["same"]["p_value_t"] is None and got["apart"]["p_value_t"] == 0.0 and got["apart"]["cohens_d"] == 0.0


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(24):
        for c in range(9):
            if rng.uniform() < 0.8:
                rows.append((f"g{s % 2}", f"s{s:02d}", f"c{c}", 1.0, 1.0, float(np.round(rng.lognormal(0, 1), 2))))
    return rows, spark.createDataFrame(rows, PEAKS).cache()


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_equals_pandas(table, method):
    rows, df = table
    wide = pd.DataFrame(rows, columns=["g", "s", "c", "rt", "a", "v"]).pivot_table(index="s", columns="c", values="v")
    if method == "pearson":
        want = wide.corr()
    for r in getattr(correlation, method)(df).collect():
        both = wide[[r["a"], r["b"]]].dropna()
        if method == "spearman":
            both = both.rank()
        assert r["n"] == len(both) and r["r"] == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)


def test_correlation_blocks_give_the_same(table, monkeypatch):
    _, df = table
    one = {(r["a"], r["b"]): r["r"] for r in correlation.pearson(df).collect()}
    monkeypatch.setattr(correlation, "BLOCK", 2)
    monkeypatch.setattr(correlation, "SAMPLES_PER_TASK", 5)
    many = {(r["a"], r["b"]): r["r"] for r in correlation.pearson(df).collect()}
    assert set(one) == set(many) and all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)


def test_spearman_without_missing_cells(spark):
    rng = np.random.default_rng(12)
    values = np.round(rng.normal(0, 1, (15, 4)), 1)
    rows = [("g", f"s{i}", f"c{j}", 1.0, 1.0, float(values[i, j])) for i in range(15) for j in range(4)]
    want = pd.DataFrame(values).rank().corr()
    for r in correlation.spearman(spark.createDataFrame(rows, PEAKS)).collect():
        assert r["r"] == pytest.approx(want.iloc[int(r["a"][1]), int(r["b"][1])], abs=1e-9)


def test_pca_equals_numpy(table):
    rows, df = table
    wide = pd.DataFrame(rows, columns=["g", "s", "c", "rt", "a", "v"]).pivot_table(index=["g", "s"], columns="c", values="v").fillna(0)
    x = (wide - wide.mean()) / wide.std(ddof=0)
    values, vectors = np.linalg.eigh(np.cov(x.T.to_numpy()))
    order = np.argsort(values)[::-1][:3]
    scores, loadings, shares = correlation.principal_components(df)
    assert shares == pytest.approx(list(values[order] / values.sum()), abs=1e-9)
    got = scores.toPandas().set_index(["grp", "sample"]).loc[list(wide.index)]
    for k in range(3):
        v = vectors[:, order[k]]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert got[f"pc{k + 1}"].to_numpy() == pytest.approx(x.to_numpy() @ v, abs=1e-8)
    for r in correlation.confidence_ellipses(scores).collect():
        points = got.loc[r["grp"]][["pc1", "pc2"]].to_numpy()
        eig = np.linalg.eigvalsh(np.cov(points.T))
        assert (r["width"], r["height"]) == pytest.approx(tuple(2 * np.sqrt(5.991 * eig)))


def test_histogram_of_a_constant_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 3.0)], "grp string, conc double")
    assert {(r["grp"], r["bin"], r["n"]) for r in stats.histogram(df).collect()} == {("a", 15, 2), ("b", 0, 1), ("b", 29, 1)}


def test_filters_and_nulls(spark):
    df = spark.createDataFrame(
        [("RT_1.0", 5.0, None, None), ("decane", 20.0, 80, None), (None, 30.0, 60, None), ("Siloxane D4", 40.0, 700, 999), ("rt_2", 1.0, 650, 999)],
        "compound string, area double, match_factor int, match_scale int")
    def names(d):
        return [r["compound"] for r in d.collect()]
    assert names(filters.min_match(df, 70)) == ["RT_1.0", "decane", "Siloxane D4"]
    assert names(filters.identified(df)) == ["decane", "Siloxane D4"]
    assert names(filters.without_contaminants(df)) == ["RT_1.0", "decane", None, "rt_2"]
    assert names(filters.include_compounds(df, "DEC, d4")) == ["decane", "Siloxane D4"]
    assert names(filters.exclude_compounds(df, "dec")) == ["RT_1.0", None, "Siloxane D4", "rt_2"]


def test_groups_and_numbers(spark):
    df = spark.createDataFrame([("g", "Sample001.D"), ("g", "Sample010.D"), ("g", "x液体 12 唐-3.D"), ("g", "odd")], "grp string, sample string")
    got = {r["sample"]: r["grp"] for r in samples.set_groups(df, "T", "1-5, odd").collect()}
    assert [s for s, g in got.items() if g == "T"] == ["Sample001.D", "odd"]
    row = {r["sample"]: r for r in samples.with_sample_columns(df).collect()}
    assert row["x液体 12 唐-3.D"]["sample_num"] == 12 and row["x液体 12 唐-3.D"]["sub_group"] == "g - 液体"
    assert row["odd"]["sample_num"] == 999 and row["Sample010.D"]["sample_num"] == 10


def test_retention_index(spark):
    names = ["n-dodecane", "dodecane", "C12", "decane", "hexadecane", "cyclodecane", "octane, 2-methyl", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(kovats.carbon_number(F.col("n"))).collect()] == [12, 12, 12, 10, 16, None, 8, None]
    anchors = spark.createDataFrame([(8, 5.0), (10, 9.0), (12, 11.0)], "carbon int, rt double")
    df = spark.createDataFrame([(v,) for v in (3.0, 5.0, 7.0, 10.0, 12.0, 90.0)], "rt double")
    assert [r["ri"] for r in kovats.calibrate(df, anchors).collect()] == [700.0, 800.0, 900.0, 1100.0, 1300.0, 5000.0]


def test_name_pairs_equal_brute_force(spark):
    names = ["hexanal", "hexane", "2-hexanal acid", "al", "zzz", "an"]
    refs = ["hexan", "hexanal", "nal a", "anal", "q", "alpha zzz beta"]
    got = {(r["name"], r["ref_name"]) for r in kovats.name_pairs(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in refs], "ref_name string")).collect()}
    assert got == {(n, r) for n in names for r in refs if n in r or r in n}


def test_classes(spark):
    rows = [("Vanillin", "C8H8O3"), ("", "C"), ("hexamethylcyclotrisiloxane", "C6H18O3Si3"), ("penicillamine", "C5H11NO2S"), ("qqq", None), ("caffeine", "C8H10N4O2")]
    df = spark.createDataFrame([(n, f, [(41.0, 1)] * 20) for n, f in rows], "name string, formula string, peaks array<struct<mz:double,intensity:int>>")
    got = [(r["compound_class"], round(r["class_confidence"], 4)) for r in lib_ops.classify(df).collect()]
    assert got[0] == ("food_flavor", 1.0) and got[1] == ("other", 0.0) and got[2][0] == "industrial" and got[4] == ("other", 0.3)
    assert got[5][0] == "pharmaceutical"
    assert [r[0] for r in df.limit(1).select(lib_ops.category(F.col("name"))).collect()] == ["phenol/polyphenol"]


def test_rt_library_ties_and_bleed(spark):
    peaks = spark.createDataFrame([("s", "RT_5.000", 5.0), ("s", "rt_9", 9.0), ("s", "known", 5.0), ("s", "RT_7", 7.0)], "sample string, compound string, rt double")
    table = spark.createDataFrame([(0, "first", "x", 4.75), (1, "second", "x", 5.25), (2, "d4", "siloxane", 9.25)], "ord int, name string, cat string, rt_est double")
    got = sorted((r["rt"], r["compound"], r["exclude_hint"]) for r in rtmatch.match_rt_library(peaks, table).collect() if r["compound"] != "known")
    assert got == [(5.0, "first", None), (7.0, "RT_7", None), (9.0, "[EXCLUDE] d4", "column_bleed")]


def test_worklist_and_upsert(spark):
    lib = spark.createDataFrame([(1, "Hexanal", None), (2, "al", None), (3, "done", ""), (4, "old", None), (5, "has", "1-1-1")], "load_seq int, name string, cas string")
    known = spark.createDataFrame([("old",)], "name string")
    checked = spark.createDataFrame([("DONE",)], "name string")
    assert [r["name"] for r in enrichment.worklist(lib, known, checked, missing="cas").collect()] == ["Hexanal"]
    new, old = spark.createDataFrame([("a", 1.0)], "name string, ri double"), spark.createDataFrame([("a", 9.0), ("b", 2.0)], "name string, ri double")
    assert {(r["name"], r["ri"]) for r in enrichment.upsert(new, old).collect()} == {("a", 1.0), ("b", 2.0)}


def test_far_tail_of_the_rank_test_is_exact():
    import math

    from peakloom.functions import pvalues

    for n1, n2 in ((8, 1000), (5, 7)):
        ways = math.comb(n1 + n2, n1)
        # partitions of 0, 1, 2 and 3: 1 + 1 + 2 + 3 ways
        assert pvalues._exact_u_tail(n1, n2, n1 * n2 - 3) == pytest.approx(7 / ways, rel=1e-12)
    assert not pvalues._exact_counts_ok(8, 10**8)


def test_products_reach_the_driver_as_one_packed_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    q, w = rng.normal(size=(40, 6)), rng.normal(size=(40, 3))
    rows = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(q, w)], "q array<double>, w array<double>").repartition(5)
    received = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: received.append(collect(df)) or received[-1])
    one, two = correlation._small_products(rows, [("q", "w"), ("w", "w")])
    assert np.allclose(one, q.T @ w) and np.allclose(two, w.T @ w)
    assert [len(r) for r in received] == [1]
