"""Folders of any depth, load order of libraries and versioned tables."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from peakloom.operators import enrichment
from peakloom.sources import ingest, libraries, runs

ROW = "{},BB,{},1,{},,,{}\r\n"


def put(root, path, text, encoding="utf-8"):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(text.encode(encoding))


def csv(*peaks):
    return "".join(ROW.format(*p) for p in peaks)


TXT = "Peak RetTime Type Width Area Amount Grp Name\n 1 2.5 BB 0.0456 {} 0.5 {}\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("deep folder")
    put(root, "top.D/REPORT01.CSV", csv((1, 10, 0.5, "a")), "utf-16-le")
    put(root, "g/one.D/report01.csv", csv((1, 11, 0.5, "b")), "utf-16-le")
    put(root, "year 2020/lab+x/批次/two 样品.D/REPORT01.CSV", csv((1, 12, 0.5, "c"), (2, 13, 1.5, "d")), "utf-16-le")
    # the preferred file counts, not the first name; its peaks alone are read
    put(root, "g/both.D/REPORT00.CSV", csv((1, 99, 1, "wrong")), "utf-16-le")
    put(root, "g/both.D/REPORT01.CSV", csv((1, 14, 1, "e")), "utf-16-le")
    put(root, "g/both.D/Report.TXT", TXT.format(98, "wrong"))
    # nothing in the CSV report: the text report counts, and of the texts the one called report
    put(root, "a/b/c/d/text.D/REPORT01.CSV", "1,BB\r\n", "utf-16-le")
    put(root, "a/b/c/d/text.D/a.txt", TXT.format(97, "wrong"))
    put(root, "a/b/c/d/text.D/Report.TXT", TXT.format(15, "f"))
    # the same group and sample name in another place
    put(root, "other/g/one.D/REPORT02.CSV", csv((3, 16, 2.5, "g")), "utf-16-le")
    put(root, "other/g/dead.D/REPORT01.CSV", "x", "utf-16-le")
    put(root, "other/g/raw.D/data.ms", "x")
    put(root, "g/not a run/REPORT01.CSV", csv((1, 96, 1, "wrong")), "utf-16-le")
    put(root, "g/one.D/deeper/REPORT01.CSV", csv((1, 95, 1, "wrong")), "utf-16-le")
    return str(root)


def test_runs_of_any_depth(spark, folder):
    peaks = ingest.read_reports(spark, folder)
    got = sorted((r.grp, r["sample"], r.compound, r.area, r.data_source) for r in peaks.collect())
    assert got == [
        ("Root", "top.D", "a", 10.0, "CSV"), ("d", "text.D", "f", 15.0, "TXT"), ("g", "both.D", "e", 14.0, "CSV"), ("g", "one.D", "b", 11.0, "CSV"),
        ("g", "one.D", "g", 16.0, "CSV"), ("批次", "two 样品.D", "c", 12.0, "CSV"), ("批次", "two 样品.D", "d", 13.0, "CSV"),
    ]
    assert peaks.select("run").distinct().count() == 6
    skipped = sorted((r["sample"], r.reason) for r in ingest.skipped_runs(spark, folder, peaks).collect())
    assert skipped == [("dead.D", "no peaks parsed"), ("raw.D", "raw data only")]
    total = ingest.summary(spark, folder, peaks).first().asDict()
    assert total == {
        "total_records": 7, "n_samples": 5, "n_groups": 4, "n_compounds": 7, "fallback_count": 1, "conc_min": 0.5, "conc_max": 2.5,
        "conc_mean": 1.0, "runs": 8, "csv_count": 7, "txt_count": 2, "xls_count": 0, "skipped_count": 2,
    }
    assert runs.inventory(runs.run_files(spark, folder)).count() == 8


def test_folder_without_reports(spark, tmp_path):
    put(tmp_path, "x.D/data.ms", "x")
    peaks = ingest.read_reports(spark, str(tmp_path))
    assert peaks.count() == 0 and ingest.summary(spark, str(tmp_path), peaks).first().skipped_count == 1
    with pytest.raises(AnalysisException):
        ingest.read_reports(spark, str(tmp_path / "missing")).count()


def entry(name, *ions):
    return f"Name: {name}\nNum Peaks: {len(ions)}\n" + "".join(f"{m} 9\n" for m in ions) + "\n"


def test_load_order(spark, tmp_path, monkeypatch):
    names = [f"n{i}" for i in range(400)]
    put(tmp_path, "b.MSP", "".join(entry(n, 41, 42, 43) for n in names))
    put(tmp_path, "c.Msp", "".join(entry(f"crlf{i}", 50) for i in range(300)).replace("\n", "\r\n"))
    # records without blank lines between them, and the same record again
    put(tmp_path, "d.msp", "Name: same\nNum Peaks: 1\n41 9\n" * 3 + "\n" + entry("same", 41))
    put(tmp_path, "a.JSON", json.dumps([{"name": f"j{i}", "spectrum": "41:1 42:2 43:3"} for i in range(5)] + [{"name": "j0", "spectrum": "41:1 42:2 43:3"}]))
    put(tmp_path, "e.csv", "name,mz1,int1,mz2,int2,mz3,int3\nwide,1,1,2,2,3,3\nwide,1,1,2,2,3,3\n")
    put(tmp_path, "f.Csv", "compound,spectrum\nlisted,41:1 42:2 43:3\n")
    put(tmp_path, "g.csv", "name,mz1,int1,mz2,int2,mz3,int3\nafter,1,1,2,2,3,3\n")
    put(tmp_path, ".hidden.msp", entry("hidden", 1))
    put(tmp_path, "note.txt", "Name: note")
    put(tmp_path, "sub/x.msp", entry("below", 1))
    builtin = spark.createDataFrame([("z",), ("y",)], "name string").withColumn("peaks", F.array().cast("array<struct<mz:double,intensity:int>>")).coalesce(1)
    want = ["z", "y", *[f"j{i}" for i in range(5)], "j0", *names, *[f"crlf{i}" for i in range(300)], *["same"] * 4, "wide", "wide", "listed", "after"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        loaded = libraries.load_libraries(spark, str(tmp_path), builtin=builtin)
        rows = loaded.orderBy("load_seq").collect()
        splits = spark.read.text(str(tmp_path / "c.Msp")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert splits > 3
    assert [r.name for r in rows] == want
    assert [r.load_seq for r in rows] == list(range(len(want))) and all(r.lib_id == r.load_seq for r in rows)
    again = libraries.load_libraries(spark, str(tmp_path), ["g.csv"], builtin).orderBy("load_seq")
    assert [r.name for r in again.collect()] == [n for n in want if n not in ("wide", "listed")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no library files"):
        libraries.load_libraries(spark, str(tmp_path / "none"))


def test_table_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, "name string, ri double")
    with pytest.raises(ValueError, match="no version"):
        enrichment.load_table(spark, path)
    assert enrichment.upsert_table(frame([("a", 1.0), ("b", 2.0)]), path) == 1
    old = enrichment.load_table(spark, path)
    assert enrichment.upsert_table(frame([("b", 3.0), ("c", 4.0)]), path) == 2
    read = lambda df: sorted(map(tuple, df.collect()))
    assert read(enrichment.load_table(spark, path)) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    # a reader of the older version goes on with it
    assert read(old) == read(enrichment.load_table(spark, path, 1)) == [("a", 1.0), ("b", 2.0)]
    # a write that did not end is no version
    (tmp_path / "table" / "staged-x").mkdir()
    assert enrichment.save_table(frame([("only", 1.0)]), path) == 3
    assert enrichment.remove_versions(spark, path, keep=1) == [1, 2]
    assert read(enrichment.load_table(spark, path)) == [("only", 1.0)]


def test_two_writers_take_two_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    one = spark.createDataFrame([("a", 1.0)], "name string, ri double")
    enrichment.save_table(one, path)
    known, looks = enrichment._versions, []

    def first_look_misses_it(session, table):
        looks.append(table)
        return [] if len(looks) == 1 else known(session, table)

    monkeypatch.setattr(enrichment, "_versions", first_look_misses_it)
    assert enrichment.save_table(one, path) == 2
