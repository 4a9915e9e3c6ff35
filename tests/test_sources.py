import json
import time

import pytest
from pyspark.sql import functions as F

from peakloom.operators import enrichment, library as lib_ops, rtmatch
from peakloom.plans import workflows
from peakloom.sources import ingest, libraries, reports, runs, sinks, traces


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")

    def put(path, text, encoding="utf-8"):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text.encode(encoding))

    rows = '1,1.25,BB,x\r\n'  # short row
    good = '2.1234,"BB",100.5,0.5,1.5,,,"Aspartic Acid"\r\n3.5,BV,200,0.7,2.5,,,"a, b"\r\nbad,BB,1,1,1,,,zinc\r\n4,BB,1,1,1,,,name that is far too long\r\n'
    put("G1/S1.D/REPORT01.CSV", "﻿" + good + rows, "utf-16-le")
    put("G1/S2.D/REPORT01.CSV", '1.5,BB,10,1,2,,,serine\r\n2.5,BB,30,1,4,,,glycine\r\n', "utf-16-le")
    put("G2/S3.D/Report.TXT", "Peak RetTime Type Width Area Amount Grp Name\n-----|---\n 1 2.1237 BB 0.0456 123.45 0.1234 serine\n 2 3.5 BV 0.05 50.0 1.5E-2 glycine\n")
    put("G2/S4.D/Report.TXT", "header\nCompound                  RT     Area     Amount    Conc.\nserine  2.123  10.5  0.5  0.7\nbeta alanine  3.1  20  1.5\nSignal 2\nglycine  4.0  1.0  1.0\n")
    put("G2/S5.D/Report.TXT", "RT[min]\tArea\tAmount[g/100g]\tName\n1.5\t10\t0.25\t\"Serine\"\nx\t1\t1\tbad\n2.5\t20\t0.75\tglycine\n", "utf-16-le")
    put("G2/S6.D/tic_front.csv", "source,2020\nStart of data points\n0.0,5\n0.5,15\nbad,1\n1.0,10\n")
    put("G2/S6.D/S6_library1.csv", 'Name,CAS#,RT,Area,Match,R.Match,Height,Width,Formula\n"hexanal, n-",66-25-1,1.02,"1,234",91.7,92,10,0.1,C6H12O\nunknown,,0.5,5,50,,1,1,\nshort\n')
    put("S7.D/data.ms", "x")
    put("S7.D/notes.abc", "x")
    return str(root)


def test_inventory(spark, folder):
    files = runs.run_files(spark, folder)
    got = {r["sample"]: r for r in runs.inventory(files).collect()}
    assert got["S1.D"]["grp"] == "G1" and got["S7.D"]["grp"] == "Root"
    assert got["S1.D"]["report_types"] == ["CSV"] and got["S7.D"]["raw_only"] and got["S6.D"]["ready"] and not got["S6.D"]["has_reports"]
    plan = {r["sample"]: r["strategy"] for r in runs.check_files(files).collect()}
    assert (plan["S1.D"], plan["S6.D"], plan["S7.D"]) == ("ready_csv", "ready_tic", "needs_export")
    assert {r["strategy"]: r["n"] for r in runs.strategy_counts(runs.check_files(files)).collect()}["ready_csv"] == 5


def test_report_csv(spark, folder):
    got = reports.read_report_csv(spark, f"{folder}/G1/S1.D/REPORT01.CSV", max_name=20).orderBy("rt").collect()
    assert [(r["rt"], r["peak_type"], r["compound"], r["conc"]) for r in got] == [(2.1234, "BB", "aspartic acid", 1.5), (3.5, "BV", "a, b", 2.5)]
    assert got[0]["grp"] == "G1" and got[0]["sample"] == "S1.D"


def test_text_layouts(spark, folder):
    got = {}
    for r in reports.read_report_txt(spark, f"{folder}/G2/*.D/*.TXT").collect():
        got.setdefault(r["sample"], []).append((r["rt"], r["area"], r["conc"], r["compound"]))
    assert sorted(got["S3.D"]) == [(2.124, 123.5, 0.1234, "serine"), (3.5, 50.0, 0.015, "glycine")]
    assert sorted(got["S4.D"]) == [(2.123, 10.5, 0.7, "serine"), (3.1, 20.0, 1.5, "beta alanine")]
    assert sorted(got["S5.D"]) == [(1.5, 10.0, 0.25, "serine"), (2.5, 20.0, 0.75, "glycine")]


def test_ingest_and_batch_analysis(spark, folder, tmp_path):
    peaks = ingest.read_reports(spark, folder)
    assert {r["sample"]: r["count"] for r in peaks.groupBy("sample").count().collect()} == {"S1.D": 3, "S2.D": 2, "S3.D": 2, "S4.D": 2, "S5.D": 2}
    skipped = {r["sample"]: r["reason"] for r in ingest.skipped_runs(spark, folder, peaks).collect()}
    assert skipped == {"S6.D": "trace only", "S7.D": "raw data only"}
    tables = workflows.batch_analysis(spark, folder)
    assert tables["overview"].first()["samples"] == 5
    assert {r["compound"] for r in tables["statistics"].collect()} >= {"serine", "glycine"}
    workflows.export(tables["raw_data"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/bundle/raw_data")).count() == 11
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/summary")).count() == 5


def test_traces_and_vendor_hits(spark, folder):
    t = traces.read_traces(spark, f"{folder}/G2/*.D/tic_front.csv")
    assert [(r["idx"], r["t"], r["y"]) for r in t.orderBy("idx").collect()] == [(0, 0.0, 5.0), (1, 0.5, 15.0), (2, 1.0, 10.0)]
    m = traces.trace_metadata(t).first()
    assert (m["n_points"], m["rt_max"], m["max_intensity"], m["mean_intensity"]) == (3, 1.0, 15, 10)
    parsed = reports.parse_vendor_hits(reports.read_texts(spark, f"{folder}/G2/*.D/*library*.csv"))
    row = parsed.filter("compound <> 'unknown'").first()
    assert (row["compound"], row["cas"], row["rt"], row["area"], row["match_factor"], row["formula"]) == ("hexanal, n-", "66-25-1", 1.02, 1234.0, 91, "C6H12O")
    hits = reports.vendor_hits(runs.run_files(spark, folder), parsed)
    assert [(r["sample"], r["file_priority"]) for r in hits.select("sample", "file_priority").distinct().collect()] == [("S6.D", 0)]
    peaks = spark.createDataFrame([("S6.D", 1.0, "RT_1.000"), ("S6.D", 1.5, "RT_1.500")], "sample string, rt double, compound string")
    merged = {r["rt"]: r for r in rtmatch.merge_vendor_hits(peaks, hits).collect()}
    assert merged[1.0]["compound"] == "hexanal, n-" and merged[1.0]["match_scale"] == 100 and merged[1.5]["compound"] == "RT_1.500"


MSP = """NAME: Hexanal
CASNO: 66-25-1
FORMULA: C6H12O
RT_EXP: 4.5
RETENTIONINDEX: 801.5
COMPOUND_CLASS: food_flavor
Synon: caproaldehyde
Synon: hexaldehyde
NUM PEAKS: 4
41 300; 44.9 999; 57 500;
72 100

Name: Limonene
DB#: X1
InChIKey: AAA
ExactMass: 136.1
Num Peaks: 4
68.05 999
93 500.7
5 100
121 20
Name: Last
Num Peaks: 1
50 9"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_msp(spark, tmp_path, end):
    (tmp_path / "a.msp").write_bytes(MSP.replace("\n", end).encode())
    for line_end in ("\n", "\r\n"):
        got = {r["name"]: r for r in libraries.read_msp(spark, str(tmp_path / "a.msp"), line_end).collect()}
        assert set(got) == {"hexanal", "limonene", "last"}
        h, l = got["hexanal"], got["limonene"]
        assert (h["cas"], h["formula"], h["rt_exp"], h["ri_exp"], h["compound_class"]) == ("66-25-1", "C6H12O", 4.5, 801.5, "food_flavor")
        assert h["synonyms"] == ["caproaldehyde", "hexaldehyde"] and h["source_file"] == "a.msp" and h["num_peaks"] == 4
        assert [tuple(p) for p in h["peaks"]] == [(41.0, 300), (44.0, 999), (57.0, 500), (72.0, 100)]
        assert [tuple(p) for p in l["peaks"]] == [(68.05, 999), (93.0, 500), (121.0, 20)]
        assert (l["accession"], l["inchikey"], l["mw"]) == ("X1", "AAA", 136.1)
        assert [tuple(p) for p in got["last"]["peaks"]] == [(50.0, 9)]


def test_other_libraries_and_dedup(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([
        {"compound": " Hexanal ", "casNumber": "66-25-1", "spectrum": "41:300 44:999 57:500 x:1 72.5:9", "id": "M1"},
        {"name": "", "spectrum": "1:2"}, {"name": "empty", "spectrum": ""}]))
    (tmp_path / "c.csv").write_text("Name,CAS,Formula,mz1,int1,mz2,int2,mz3,int3\nHexanal,66-25-1,C6H12O,41,1,44,2,57,3\nNew,,C2,1,1,2,2,3,3\nFew,,C2,1,1,,,,\n")
    (tmp_path / "d.csv").write_text("compound,spectrum\nTokens,41:1 42:2 43.7:3\nPairs,41 1 42 2\n")
    (tmp_path / "a.msp").write_text(MSP)
    assert [tuple(p) for p in libraries.read_library_csv(spark, str(tmp_path / "d.csv")).filter("name = 'tokens'").first()["peaks"]] == [(41.0, 1), (42.0, 2), (43.0, 3)]
    lib = libraries.load_libraries(spark, str(tmp_path), ["c.csv", "d.csv"])
    assert {r["source"]: r["n"] for r in lib_ops.entries_by_source(lib).collect()} == {"msp_file": 3, "mona_json": 1, "nist_webbook_csv": 3}
    kept = lib_ops.deduplicate(lib)
    assert {r["name"] for r in kept.collect()} == {"hexanal", "limonene", "new", "tokens"}
    # same priority, more ions win; a lower priority never does
    assert kept.filter("name = 'hexanal'").first()["source"] in ("msp_file", "mona_json")
    assert lib_ops.deduplicate(kept).count() == kept.count()


def test_write_and_read_msp(spark, tmp_path):
    lib = libraries.with_load_order(libraries.parse_msp(libraries.msp_records(spark.createDataFrame([(MSP,)], "value string"))).withColumns(
        {"source": F.lit("msp_file"), "source_file": F.lit("x")}))
    sinks.write_msp(lib, str(tmp_path / "out"))
    back = {r["name"]: r for r in libraries.read_msp(spark, str(tmp_path / "out")).collect()}
    for r in lib.collect():
        assert len(back[r["name"]]["peaks"]) == len(r["peaks"]) and back[r["name"]]["cas"] == r["cas"] and back[r["name"]]["ri_exp"] == r["ri_exp"]


def test_ri_table_pages_and_responses(spark, tmp_path):
    (tmp_path / "ri.json").write_text(json.dumps({"Hexanal": {"ri": 800.5}, "Low": {"ri": 300}, "X": {"ri": 900, "n": 3, "all_ri": [1.0], "cas": "1"}}))
    got = {r["name"]: r for r in libraries.read_ri_table(spark, str(tmp_path / "ri.json")).collect()}
    assert set(got) == {"hexanal", "x"} and got["hexanal"]["n"] == 1 and got["hexanal"]["all_ri"] == [800.5] and got["x"]["n"] == 3

    def cell(v):
        return f'<td class="right-nowrap"> {v} </td>'

    pages = [
        (1, "Kovats CAS Registry Number: 66-25-1" + cell("801.50") + cell("790.0") + cell("801.5") + cell("4100.0") + cell("12345.0")),
        (2, cell("801.5")), (3, "Gas Chromatography" + cell("500.1") + cell("600.2") + cell("700.3")),
    ]
    out = {r["id"]: r for r in enrichment.page_values(spark.createDataFrame(pages, "id int, html string")).collect()}
    assert out[1]["ri_values"] == [790.0, 801.5] and out[1]["ri"] == 801.5 and out[1]["cas"] == "66-25-1"
    assert out[2]["n"] == 0 and out[2]["ri"] is None and out[3]["ri"] == 600.2
    bodies = [
        ('{"InformationList":{"Information":[{"Synonym":["hexanal"," 66-25-1 ","1-11-1"]}]}}',), ("not json",), ('{"InformationList":{}}',)]
    got = [r["cas"] for r in enrichment.first_cas(spark.createDataFrame(bodies, "body string")).collect()]
    assert got == ["66-25-1", None, None]


def test_scans(spark):
    rows = [("s", 90.0, [(41.0, 50.0), (43.0, 200.0), (50.0, -1.0)]), ("s", 95.0, [(1.0, 0.0)])]
    df = spark.createDataFrame(rows, "sample string, scan_rt double, peaks array<struct<mz:double,intensity:double>>")
    got = traces.normalise_scans(df, seconds=True).collect()
    assert len(got) == 1 and got[0]["scan_rt"] == 1.5 and [tuple(p) for p in got[0]["peaks"]] == [(41.0, 249), (43.0, 999)]


def test_long_quantitation_report_takes_time_in_proportion(spark):
    # end and header of the table are found once per file, not once per line
    head = "Compound      RT     Area    Amount    Conc."
    rows = [f"name{i}   {i / 1000}  {i + 1}.5  0.25  0.5" for i in range(20_000)]
    text = "\n".join([head, *rows, "Signal 2", "late   1.0  2.0  3.0  4.0"])
    df = reports.parse_report_texts(spark.createDataFrame([("/d/G/S.D/Report.TXT", text)], "path string, text string"))
    start = time.perf_counter()
    n, last, late = df.agg(F.count("*"), F.max("area"), F.count_if(F.col("compound") == "late")).first()
    assert (n, last, late) == (20_000, 20_000.5, 0)
    assert time.perf_counter() - start < 20
