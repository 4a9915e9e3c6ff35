"""Ingest of whole data folders: S15. Runs are found at any depth by one recursive listing of file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peakloom.operators.samples import with_sample_columns
from peakloom.sources.reports import read_report_csv, read_report_txt
from peakloom.sources.runs import inventory, run_files

_COLUMNS = ["path", "rt", "peak_type", "area", "amount", "conc", "compound"]

# The report files of a run by source, each source's in order of preference; letter case does not matter.
REPORT_FILES = {
    "CSV": ["(?i)^report01[.]csv$", "(?i)^report.*[.]csv$"],
    "TXT": ["(?i)^report.*[.]txt$", "(?i)[.]txt$"],
}
_GLOBS = {"CSV": "[Rr][Ee][Pp][Oo][Rr][Tt]*.[Cc][Ss][Vv]", "TXT": "*.[Tt][Xx][Tt]"}
_READERS = {"CSV": read_report_csv, "TXT": read_report_txt}


def report_files(files: DataFrame) -> DataFrame:
    """The report file of each run and source, from a listing: folder, grp, sample, data_source, priority, path."""

    def preference(patterns: list[str]) -> Column:
        out = F.lit(None).cast("int")
        for i, pattern in reversed(list(enumerate(patterns))):
            out = F.when(F.col("file").rlike(pattern), i).otherwise(out)
        return out

    kinds = [F.struct(F.lit(n).alias("priority"), F.lit(s).alias("data_source"), preference(p).alias("order")) for n, (s, p) in enumerate(REPORT_FILES.items())]
    offered = files.withColumn("k", F.explode(F.array(*kinds))).filter(F.col("k.order").isNotNull())
    best = F.min(F.struct("k.order", "file", "path")).alias("best")
    return offered.groupBy("folder", "grp", "sample", F.col("k.data_source").alias("data_source"), F.col("k.priority").alias("priority")).agg(best).select(
        "folder", "grp", "sample", "data_source", "priority", F.col("best.path").alias("path")
    )


def read_reports(spark: SparkSession, data_dir: str) -> DataFrame:
    """Peaks of all runs below a folder, from the CSV report where it yields any peak of a run, else from the text report.

    Each reader finds its files by name at any depth; the listing joined to the parsed rows says which file of a run
    counts, and the first source that yields rows wins. Adds ``run``, the folder of the run, and ``data_source``.
    """
    wanted = report_files(run_files(spark, data_dir))
    rows = None
    for source, read in _READERS.items():
        parsed = read(spark, data_dir, name_glob=_GLOBS[source]).select(*_COLUMNS).withColumn("data_source", F.lit(source))
        rows = parsed if rows is None else rows.unionByName(parsed)
    located = rows.join(wanted, ["path", "data_source"])
    first = located.groupBy("folder").agg(F.min("priority").alias("priority"))
    chosen = located.join(first, ["folder", "priority"])
    return with_sample_columns(
        chosen.select("grp", "sample", *[c for c in _COLUMNS if c != "path"], F.col("folder").alias("run"), "data_source")
    )


def skipped_runs(spark: SparkSession, data_dir: str, peaks: DataFrame) -> DataFrame:
    """Runs that gave no peaks, with the reason."""
    runs = inventory(run_files(spark, data_dir))
    done = peaks.select(F.col("run").alias("folder")).distinct()
    reason = F.when(F.col("has_reports"), "no peaks parsed").when(F.col("has_tic"), "trace only").when(F.col("has_raw"), "raw data only").otherwise("no reports")
    return runs.join(done, "folder", "left_anti").select("grp", "sample", "folder", reason.alias("reason"))


def summary(spark: SparkSession, data_dir: str, peaks: DataFrame) -> DataFrame:
    """One row: records, samples and groups read, runs that offer each kind of report, runs read from text because their CSV
    report gave nothing, the range of concentrations, and runs without peaks."""
    runs = inventory(run_files(spark, data_dir))
    offers = [F.count_if(F.array_contains("report_types", kind)).alias(f"{kind.lower()}_count") for kind in ("CSV", "TXT", "XLS")]
    offered = runs.agg(F.struct(F.count(F.lit(1)).alias("runs"), *offers).alias("o")).scalar()
    return peaks.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_distinct("sample").alias("n_samples"), F.count_distinct("grp").alias("n_groups"),
        F.count_distinct("compound").alias("n_compounds"), F.count_distinct("run").alias("n_read"),
        F.count_distinct(F.when(F.col("data_source") != "CSV", F.col("run"))).alias("fallback_count"),
        F.round(F.min("conc"), 6).alias("conc_min"), F.round(F.max("conc"), 4).alias("conc_max"), F.round(F.avg("conc"), 4).alias("conc_mean"),
    ).withColumn("o", offered).select("*", "o.*").withColumn("skipped_count", F.col("runs") - F.col("n_read")).drop("o", "n_read")
