import numpy as np
from pyspark.sql import functions as F

from peakloom.plans import workflows
from peakloom.sources import sinks

IONS = "array<struct<mz:double,intensity:int>>"


def test_trace_to_identified_table(spark, tmp_path):
    t = np.arange(600) / 100
    rows, scans = [], []
    for k in range(3):
        y = 1000 + sum(h * np.exp(-((t - c) / 0.05) ** 2) for h, c in ((2e6, 1.0 + k * 0.01), (1e6, 3.0), (5e5, 5.0)))
        rows += [(f"s{k}.D", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, y))]
        scans += [(f"s{k}.D", 3.001, [(41.0, 300), (43.0, 999), (57.0, 500), (71.0, 200), (85.0, 90)])]
    tic = spark.createDataFrame(rows, "sample string, idx int, t double, y double")
    scans = spark.createDataFrame(scans, f"sample string, scan_rt double, peaks {IONS}")
    runs = spark.createDataFrame([(f"s{k}.D", "g") for k in range(3)], "sample string, grp string")
    library = spark.createDataFrame(
        [(1, "nonane", "111-84-2", "C9H20", 3.4, 900.0, "builtin_msp", [(41.0, 310), (43.0, 999), (57.0, 480), (71.0, 210), (85.0, 80)]),
         (2, "other", None, None, 3.0, None, "msp_file", [(200.0, 999), (201.0, 50), (202.0, 5)])],
        f"lib_id long, name string, cas string, formula string, rt_exp double, ri_exp double, source string, peaks {IONS}")
    rt_library = spark.createDataFrame([(0, "late", "x", 5.1)], "ord int, name string, cat string, rt_est double")
    hits = spark.createDataFrame(
        [("s0.D", 0, "f", 1, 1.01, "vendor name", 90, 80, "", "")],
        "sample string, file_priority int, file string, hit_seq int, rt double, compound string, match_factor int, reverse_match int, formula string, cas string")
    out = workflows.trace_analysis(tic, runs, scans, library, rt_library, hits, min_area=1000).cache()
    got = {(r["sample"], round(r["rt"])): (r["compound"], r["match_method"]) for r in out.collect()}
    assert len(got) == 9
    assert got[("s0.D", 1)] == ("vendor name", "vendor")
    # the only scan of a run is its nearest scan everywhere, and the gate of a near-perfect match is wide
    assert got[("s1.D", 3)] == ("nonane", "spectral_library")
    ri_ref = spark.createDataFrame([(0, "nonane", 900.0, 1)], "ord int, name string, ri double, n int")
    named, matches = workflows.identify_with_ri(
        out.withColumns({"compound": F.lit("RT_3"), "ri": F.lit(905.0)}), scans, library, ri_ref, spread=True)
    best = matches.filter("rank = 1").first()
    assert best["confidence"] == "confirmed" and "RI_CONFIRMED" in best["flags"] and "CURATED_SPECTRUM" in best["flags"]
    assert {r["compound"] for r in named.collect()} == {"nonane"}


def test_report_sections(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"g{s % 2}", f"s{s}", f"c{c}", 1.0, 1.0, float(rng.normal(5 + c + (s % 2), 0.3))) for s in range(8) for c in range(4)]
    peaks = spark.createDataFrame(rows, "grp string, sample string, compound string, rt double, area double, conc double")
    sections = workflows.comprehensive_report(peaks)
    assert sections["group_comparison"].count() == 4 and sections["data_overview"].first()["samples"] == 8
    sinks.write_report(sections, str(tmp_path / "r"))
    assert {r["section"] for r in spark.read.json(str(tmp_path / "r")).select("section").distinct().collect()} == {k for k, v in sections.items() if not v.isEmpty()}


def test_calibration_in_one_call(spark):
    ladder = [("g", "alkane mix.D", f"c{c}", 1.0 + c * 0.5, 5000.0) for c in (8, 9, 10, 12, 14)]
    peaks = [("g", "s1.D", "nonane blend", 5.6, 9000.0), ("g", "s1.D", "other", 6.25, 9000.0)]
    df = spark.createDataFrame(ladder + peaks, "grp string, sample string, compound string, rt double, area double")
    ri_ref = spark.createDataFrame([(0, "nonane", 910.0, 1)], "ord int, name string, ri double, n int")
    out = workflows.calibrate_ri(df, ri_ref, "alkane")
    assert sorted(map(tuple, out["anchors"].collect())) == [(8, 5.0), (9, 5.5), (10, 6.0), (12, 7.0), (14, 8.0)]
    assert {r.compound: r.ri for r in out["peaks"].filter("sample = 's1.D'").collect()} == {"nonane blend": 920.0, "other": 1050.0}
    assert [(r.compound, r.db_match, r.confidence) for r in out["cross_reference"].filter("compound like '%blend'").collect()] == [("nonane blend", "nonane", "high")]
    # no alkane is named: the peaks in regular order stand for them
    plain = spark.createDataFrame([("g", "x.D", f"p{i}", 1.0 + 0.8 * i, 5000.0) for i in range(6)], "grp string, sample string, compound string, rt double, area double")
    spaced = sorted((r.carbon, round(r.rt, 6)) for r in workflows.calibrate_ri(plain)["anchors"].collect())
    assert spaced == [(8 + i, round(1.0 + 0.8 * i, 6)) for i in range(6)]


def test_hints_for_peaks_without_a_match(spark):
    peaks = spark.createDataFrame([("g", "a.D", "hexanal", 3.0, 1.0), ("g", "a.D", "nothing", 9.0, 1.0)], "grp string, sample string, compound string, rt double, area double")
    scans = spark.createDataFrame([], f"sample string, scan_rt double, peaks {IONS}")
    library = spark.createDataFrame([(1, "hexanal dimethyl acetal", 3.4, [(41.0, 310), (43.0, 999), (57.0, 480)]), (2, "decane", 3.0, [(41.0, 1)])],
        f"lib_id long, name string, rt_exp double, peaks {IONS}")
    ri_ref = spark.createDataFrame([(0, "hexanal", 800.0, 1)], "ord int, name string, ri double, n int")
    out = workflows.identify_or_hint(peaks, scans, library, ri_ref, compound_name="hexanal")
    assert out["matches"].count() == 0 and out["peaks"].count() == 2
    assert [(r.name, r.ref_name, r["rank"]) for r in out["hints"].collect()] == [("hexanal", "hexanal dimethyl acetal", 1)]


def test_batch_is_written_as_a_whole(spark, tmp_path):
    for g, s, base in (("g1", "a", 1), ("g1", "b", 2), ("g2", "c", 5), ("g2", "d", 7)):
        folder = tmp_path / "in" / g / f"{s}.D"
        folder.mkdir(parents=True)
        text = "".join(f"{1 + k},BB,{base * 10 + k},1,{base + k * base},,,c{k}\r\n" for k in range(4))
        (folder / "REPORT01.CSV").write_bytes(text.encode("utf-16-le"))
    tables = workflows.batch_analysis(spark, str(tmp_path / "in"), path=str(tmp_path / "out"))
    for name, table in tables.items():
        assert spark.read.parquet(str(tmp_path / "out/bundle" / name)).count() == table.count(), name
    assert {"raw_data", "ingest", "statistics", "composition", "comparison", "pca_scores", "pca_loadings", "pca_ellipses", "zscores"} <= set(tables)
    assert tables["ingest"].first().csv_count == 4 and spark.read.option("header", "true").csv(str(tmp_path / "out/summary")).count() == 4
    workflows.export(tables["raw_data"], str(tmp_path / "bundle"), "bundle")
    assert {p.name for p in (tmp_path / "bundle/bundle").iterdir()} == {"raw_data", "pivot_long", "statistics", "composition", "comparison"}
