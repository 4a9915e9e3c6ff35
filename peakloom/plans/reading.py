"""Queries that write table content in the formats of the readers and read it back, and inventories of made-up listings.

Each text is built from the tables by Spark; the check starts from the tables again and never sees the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from peakloom.operators import identify, kovats, rtmatch
from peakloom.plans import views as v
from peakloom.plans.catalogue import _EXTRA, extra, query, rounded
from peakloom.session import scratch_path
from peakloom.sources import libraries, reports, runs, sinks, traces

_SAMPLE = "concat('Sample', lpad(CAST(l_suppkey AS STRING), 4, '0'), '.D')"

_EXTRA["report_lines"] = f"""
SELECT concat('G', CAST(l_suppkey % 3 AS STRING)) AS grp, {_SAMPLE} AS sample, CAST(l_suppkey % 3 AS INT) AS kind,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS n,
       2 + CAST((l_partkey * l_partkey * 31 + l_partkey * 17) % 30011 AS DOUBLE) / 1000 AS rt,
       CAST(floor(l_extendedprice * 10) AS DOUBLE) / 10 AS area, CAST(l_quantity AS DOUBLE) / 10 AS amount, CAST(l_quantity AS DOUBLE) / 8 AS conc,
       lower(p_brand) AS name, p_size
FROM lineitem JOIN part ON p_partkey = l_partkey"""

_EXTRA["run_listing"] = f"""
SELECT DISTINCT concat('G', CAST(l_suppkey % 3 AS STRING)) AS grp, {_SAMPLE} AS sample, concat('/data/G', CAST(l_suppkey % 3 AS STRING), '/', {_SAMPLE}) AS folder,
       CASE (l_suppkey * 5 + l_linenumber * l_linenumber * l_suppkey) % 13 WHEN 0 THEN 'REPORT01.CSV' WHEN 1 THEN 'report.txt' WHEN 2 THEN 'notes.TXT'
         WHEN 3 THEN 'Report01.xls' WHEN 4 THEN 'table.XLSX' WHEN 5 THEN 'tic_front.csv' WHEN 6 THEN 'data.ms' WHEN 7 THEN 'fid1A.ch' WHEN 8 THEN 'dad1.uv'
         WHEN 9 THEN 'GC.ini' WHEN 10 THEN 'acq.macaml' WHEN 11 THEN 'method.m' ELSE 'readme' END AS file
FROM lineitem"""


def _text(rows: DataFrame, line: Column, *head: str) -> DataFrame:
    """(path, text) per sample: head lines, then the lines in the order of n."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    path = F.concat(F.lit("/data/"), "grp", F.lit("/"), "sample", F.lit("/Report.TXT"))
    return rows.groupBy("grp", "sample").agg(F.array_join(lines, "\n").alias("body")).select(
        path.alias("path"), F.concat_ws("\n", *map(F.lit, head), F.col("body")).alias("text")
    )


_PEAKS_READ = "SELECT grp, sample, {rt} AS rt, {kind} AS peak_type, area, {amount} AS amount, {conc} AS conc, name AS compound FROM report_lines"


@query("read_report_txt", " UNION ALL ".join(
    _PEAKS_READ.format(rt="round(rt, 3)", kind=kind, amount="amount", conc=conc) + f" WHERE kind = {n}"
    for n, (kind, conc) in enumerate([("'BB'", "amount"), ("NULL", "conc"), ("NULL", "amount")])
), ("report_lines",))
def _read_report_txt(spark, sf_dir):
    lines = extra(spark, sf_dir, "report_lines")
    c = F.col
    table = _text(lines.filter("kind = 0"), F.concat_ws("  ", "n", "rt", F.lit("BB"), F.lit("0.0456"), "area", "amount", "name"), "Area Percent Report", "Peak RetTime Type Width Area Amount Grp Name", "-----|------")
    quant = _text(lines.filter("kind = 1"), F.concat(c("name"), F.lit("   "), F.concat_ws("  ", "rt", "area", "amount", "conc")), "Compound      RT     Area    Amount    Conc.")
    tabbed = _text(lines.filter("kind = 2"), F.concat_ws("\t", "rt", "area", "amount", F.concat(F.lit('"'), F.upper("name"), F.lit('"'))), "RT[min]\tArea\tAmount[g/100g]\tName")
    return reports.parse_report_texts(table.unionByName(quant).unionByName(tabbed)).drop("path")


@query("read_report_csv", _PEAKS_READ.format(rt="rt", kind="'BV'", amount="amount", conc="conc"), ("report_lines",))
def _read_report_csv(spark, sf_dir):
    path = scratch_path(spark)
    empty = F.lit(None).cast("string")
    lines = extra(spark, sf_dir, "report_lines").select(
        "grp", "sample", "rt", F.lit("BV").alias("kind"), "area", "amount", "conc", empty.alias("e1"), empty.alias("e2"), F.upper("name").alias("name")
    )
    lines.repartition("sample").write.partitionBy("grp", "sample").option("encoding", "UTF-16LE").csv(path)
    back = reports.read_report_csv(spark, path, name_glob="*.csv").drop("path")
    plain = {c: F.regexp_replace(c, "^[a-z]+=", "") for c in ("grp", "sample")}
    return back.withColumns(plain)


@query("read_vendor_hits", """
SELECT sample, CAST(n AS INT) AS hit_seq, CASE WHEN kind = 0 THEN concat(name, ', syn') ELSE name END AS compound, concat(CAST(100 + p_size AS STRING), '-00-1') AS cas,
       concat('C', CAST(p_size AS STRING)) AS formula, rt, area, CAST(500 + p_size AS INT) AS match_factor, CAST(400 + p_size AS INT) AS reverse_match, 0.0::DOUBLE AS height
FROM report_lines""", ("report_lines",))
def _read_vendor_hits(spark, sf_dir):
    lines = extra(spark, sf_dir, "report_lines")
    cas = F.concat(F.lit("1"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-00-1"))
    numbers = ["rt", F.concat(F.lit('"'), F.col("area").cast("string"), F.lit('"')), F.col("p_size") + 500, F.col("p_size") + 400]
    formula = F.concat(F.lit("C"), F.col("p_size").cast("string"))
    comma = F.concat_ws(",", F.concat(F.lit('"'), "name", F.lit(', syn"')), cas, *numbers, formula)
    tab = F.concat_ws("\t", "name", cas, "rt", "area", F.col("p_size") + 500, F.col("p_size") + 400, formula)
    texts = _text(lines.filter("kind = 0"), comma, "Name,CAS#,RT,Area,Match,R.Match,Formula").unionByName(
        _text(lines.filter("kind > 0"), tab, "Compound\tCAS Number\tRet Time\tAbundance\tScore\tRMF\tMolecular Formula")
    )
    return reports.parse_vendor_hits(texts).withColumn("sample", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).drop("path")


@query("read_traces", "SELECT 'G' AS grp, concat(sample, '.D') AS sample, idx, t, y FROM tic", ("tic",))
def _read_traces(spark, sf_dir):
    points = v.view(spark, sf_dir, "tic").select(F.lit("G").alias("grp"), F.concat("sample", F.lit(".D")).alias("sample"), F.col("idx").alias("n"), "t", "y")
    texts = _text(points, F.concat_ws(",", "t", "y"), "source,2020", "Start of data points")
    return traces.parse_traces(texts).drop("path")


@query("trace_metadata", """
SELECT concat(sample, '.D') AS sample, count(*) AS n_points, round(arg_min(t, idx), 3) AS rt_min, round(arg_max(t, idx), 3) AS rt_max,
       round(arg_max(t, idx) - arg_min(t, idx), 1) AS total_run_time, CAST(trunc(max(y)) AS BIGINT) AS max_intensity, CAST(trunc(min(y)) AS BIGINT) AS min_intensity
FROM tic GROUP BY sample""", ("tic",))
def _trace_metadata(spark, sf_dir):
    return traces.trace_metadata(_read_traces(spark, sf_dir)).drop("mean_intensity")


@query("normalise_scans", """
WITH s AS (SELECT spec_id, mz, intensity, max(intensity) OVER (PARTITION BY spec_id) AS top FROM spectra_all WHERE intensity > 0)
SELECT spec_id, CAST(count(*) AS INT) AS n_peaks, CAST(sum(mz * trunc(CAST(intensity AS DOUBLE) / top * 999)) AS BIGINT) AS checksum FROM s GROUP BY spec_id HAVING count(*) >= 5""", ("spectra_all",))
def _normalise_scans(spark, sf_dir):
    scans = v.collect_spectra(v.view(spark, sf_dir, "spectra_all"), "spec_id").select(
        "spec_id", F.lit(1.0).alias("scan_rt"), F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), (p["intensity"] * 37.5).alias("intensity"))).alias("peaks")
    )
    return traces.normalise_scans(scans, 5).select("spec_id", F.size("peaks").alias("n_peaks"), _checksum().alias("checksum"))


_KIND = {name: f"coalesce(bool_or(regexp_matches(lower(file), '{pattern}')), false)" for name, pattern in {
    "csv": r"^report.*\.csv$", "txt": r"^report.*\.txt$", "xls": r"^report.*\.xlsx?$", "tic": r"^tic_front\.(csv|tsv)$", "ms": r"\.ms$", "raw": r"\.(ch|uv|dad|ms)$",
}.items()}


@query("run_inventory", f"""
WITH k AS (SELECT grp, sample, folder, {", ".join(f"{c} AS {n}" for n, c in _KIND.items())} FROM run_listing GROUP BY ALL)
SELECT grp, sample, folder, concat_ws(',', CASE WHEN csv THEN 'CSV' END, CASE WHEN txt THEN 'TXT' END, CASE WHEN xls THEN 'XLS' END) AS report_types, tic AS has_tic, ms AS has_ms, raw AS has_raw,
       csv OR txt OR xls AS has_reports, csv OR txt OR xls OR tic AS ready, raw AND NOT (csv OR txt OR xls OR tic) AS raw_only FROM k""", ("run_listing",))
def _run_inventory(spark, sf_dir):
    return runs.inventory(extra(spark, sf_dir, "run_listing")).withColumn("report_types", F.array_join("report_types", ","))


@query("run_strategies", r"""
WITH f AS (SELECT grp, sample, lower(file) AS file FROM run_listing),
s AS (SELECT sample, CASE WHEN bool_or(regexp_matches(file, '^report.*\.csv$|\.txt$|^report.*\.xls|\.xlsx$')) THEN 'ready_csv' WHEN bool_or(regexp_matches(file, '^tic_front\.(csv|tsv)$')) THEN 'ready_tic'
        WHEN bool_or(regexp_matches(file, '\.(ch|uv|dad|ms)$')) THEN 'needs_export' ELSE 'empty' END AS strategy,
        count(*) FILTER (WHERE file = 'acq.macaml') AS n_other, count(*) FILTER (WHERE regexp_matches(file, '\.txt$')) AS n_txt FROM f GROUP BY sample)
SELECT * FROM s""", ("run_listing",))
def _run_strategies(spark, sf_dir):
    checked = runs.check_files(extra(spark, sf_dir, "run_listing"))
    return checked.select("sample", "strategy", F.size("other_files").cast("long").alias("n_other"), F.size("txt_reports").cast("long").alias("n_txt"))


@query("read_ri_table", "SELECT lower(name) AS name, ri, n FROM ri_ref WHERE ri > 400 AND ri < 4000", ("ri_ref",))
def _read_ri_table(spark, sf_dir):
    refs = v.ri_ref(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(16)))
    entry = F.struct(F.upper("name").alias("key"), F.struct("ri", "n").alias("value"))
    texts = refs.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))
    return libraries.parse_ri_table(texts).select("name", "ri", "n")


def _checksum() -> Column:
    return F.aggregate("peaks", F.lit(0).cast("long"), lambda a, p: a + (p["mz"] * p["intensity"]).cast("long"))


@query("read_library_json", """
SELECT l.name, l.cas, l.formula, concat('M', CAST(l.lib_id AS STRING)) AS accession, CAST(count(*) AS INT) AS num_peaks, CAST(sum(mz * intensity) AS BIGINT) AS checksum
FROM library_all l JOIN spectra_all s ON s.spec_id = l.lib_id GROUP BY l.lib_id, l.name, l.cas, l.formula""", ("library_all", "spectra_all"))
def _read_library_json(spark, sf_dir):
    path = scratch_path(spark)
    ions = F.array_join(F.transform("peaks", lambda p: F.concat(p["mz"].cast("int").cast("string"), F.lit(":"), p["intensity"].cast("string"))), " ")
    entry = F.struct(F.upper("name").alias("compound"), F.col("cas").alias("casNumber"), F.col("formula").alias("molecularFormula"), F.concat(F.lit("M"), "lib_id").alias("id"), ions.alias("spectrum"))
    part = F.pmod(F.xxhash64("lib_id"), F.lit(16)).alias("part")
    texts = v.whole_library(spark, sf_dir).groupBy(part).agg(F.to_json(F.collect_list(entry)).alias("value"))
    texts.repartition("part").write.partitionBy("part").text(path)
    return libraries.read_library_json(spark, path).select("name", "cas", "formula", "accession", "num_peaks", _checksum().alias("checksum"))


@query("read_library_csv", """
SELECT l.name, l.cas, l.formula, CAST(count(*) AS INT) AS num_peaks, CAST(sum(mz * intensity) AS BIGINT) AS checksum
FROM library_all l JOIN spectra_all s ON s.spec_id = l.lib_id AND s.ion_idx < 8 GROUP BY l.lib_id, l.name, l.cas, l.formula""", ("library_all", "spectra_all"))
def _read_library_csv(spark, sf_dir):
    path = scratch_path(spark)
    ions = [F.get("peaks", F.lit(i))[field].cast("int").alias(f"{title}{i + 1}") for i in range(8) for field, title in (("mz", "mz"), ("intensity", "int"))]
    rows = v.whole_library(spark, sf_dir).select(F.upper("name").alias("Name"), F.col("cas").alias("CAS Number"), F.col("formula").alias("Formula"), *ions)
    rows.write.option("header", "true").csv(path)
    return libraries.read_library_csv(spark, path).select("name", "cas", "formula", "num_peaks", _checksum().alias("checksum"))


@query("rough_index", "SELECT DISTINCT rt, round(rt * 100, 6) AS db5, round(rt * 110, 6) AS dbwax FROM peaks")
def _rough_index(spark, sf_dir):
    rt = F.col("rt")
    return rounded(v.peaks(spark, sf_dir).select("rt", kovats.rough_index(rt).alias("db5"), kovats.rough_index(rt, "dbwax").alias("dbwax")).distinct())


_HITS = """
WITH p AS (SELECT sample, rt, area, match_factor FROM peaks),
q AS (SELECT DISTINCT sample, rt, concat(sample, '|', CAST(CAST(round(rt * 1000) AS BIGINT) AS STRING)) AS query_id FROM p WHERE match_factor IS NOT NULL),
b AS (SELECT query_id, concat('n', CAST(CAST(round(rt * 1000) AS BIGINT) % 50 AS STRING)) AS name, CAST(600 + CAST(round(rt * 1000) AS BIGINT) % 300 AS INT) AS match_factor FROM q
      WHERE CAST(round(rt * 1000) AS BIGINT) % 3 > 0)"""


@query("peak_hits", _HITS + """
SELECT p.sample, p.rt, p.area, b.name, CASE WHEN q.query_id IS NULL THEN -1 WHEN b.match_factor IS NULL THEN 0 ELSE b.match_factor END AS match_factor
FROM p LEFT JOIN q ON q.sample = p.sample AND q.rt = p.rt LEFT JOIN b ON b.query_id = q.query_id""")
def _peak_hits(spark, sf_dir):
    peaks = v.peaks(spark, sf_dir)
    tick = F.round(F.col("rt") * 1000).cast("long")
    at = peaks.filter("match_factor IS NOT NULL").select("sample", "rt").distinct().withColumn("query_id", F.concat("sample", F.lit("|"), tick.cast("string")))
    none = F.lit(None).cast("string")
    best = at.filter(tick % 3 > 0).select(
        "query_id", F.concat(F.lit("n"), (tick % 50).cast("string")).alias("name"), none.alias("cas"), none.alias("formula"), (tick % 300 + 600).cast("int").alias("match_factor")
    )
    return rtmatch.peak_hits(peaks, at, best).drop("cas", "formula")


@query("identification_roll_up", """
WITH m AS (SELECT compound, CASE WHEN match_factor >= 90 THEN 'spectral_library' WHEN match_factor >= 70 THEN 'builtin_library' WHEN match_factor >= 60 THEN 'ms_ri_dual_high' END AS match_method FROM peaks)
SELECT match_method, count(*) AS matches, count(DISTINCT compound) AS compounds FROM m WHERE match_method IS NOT NULL GROUP BY match_method""")
def _roll_up(spark, sf_dir):
    mf = F.col("match_factor")
    method = F.when(mf >= 90, "spectral_library").when(mf >= 70, "builtin_library").when(mf >= 60, "ms_ri_dual_high")
    return identify.roll_up(v.peaks(spark, sf_dir).withColumn("match_method", method))


@query("report_sections", """
SELECT 'samples' AS section, sample AS key, count(*) AS n FROM peaks GROUP BY sample UNION ALL SELECT 'compounds' AS section, compound AS key, count(*) AS n FROM peaks GROUP BY compound""")
def _report_sections(spark, sf_dir):
    peaks = v.peaks(spark, sf_dir)
    rows = sinks.report_rows({
        "samples": peaks.groupBy(F.col("sample").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        "compounds": peaks.groupBy(F.col("compound").alias("key")).agg(F.count(F.lit(1)).alias("n")),
    })
    return rows.select("section", F.get_json_object("body", "$.key").alias("key"), F.get_json_object("body", "$.n").cast("long").alias("n"))
