"""Inventory of run folders from file names alone: S1, S2. File contents are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RUN_FILE = r"^(.*)/([^/]+)/([^/]+\.D)/([^/]+)$"


def run_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row per file directly inside a ``*.D`` folder: grp, sample, folder, file.

    The group is the parent folder, or Root for runs at the top. A folder without files leaves no trace in a listing.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(data_dir).select("path")
    )
    root = data_dir.rstrip("/")
    parent, group = F.regexp_extract("path", RUN_FILE, 1), F.regexp_extract("path", RUN_FILE, 2)
    top = F.concat(parent, F.lit("/"), group).endswith(root)
    return listing.filter(F.col("path").rlike(RUN_FILE)).select(
        F.when(top, "Root").otherwise(group).alias("grp"),
        F.regexp_extract("path", RUN_FILE, 3).alias("sample"),
        F.regexp_replace("path", "/[^/]+$", "").alias("folder"),
        F.regexp_extract("path", RUN_FILE, 4).alias("file"),
        "path",
    )


# File classes of a run folder, by file name (letter case does not matter).
FILE_CLASSES = {
    "csv_reports": r"(?i)^report.*\.csv$",
    "txt_reports": r"(?i)\.txt$",
    "xls_reports": r"(?i)(^report.*\.xls|\.xlsx)$",
    "tic_csv": r"(?i)^tic_front\.(csv|tsv)$",
    "ch_files": r"(?i)\.ch$",
    "uv_files": r"(?i)\.(uv|dad)$",
    "ms_files": r"(?i)\.ms$",
    "gc_ini": r"(?i)^gc\.ini$",
}
_KNOWN_SUFFIX = r"(?i)\.(csv|tsv|txt|xls|xlsx|ch|uv|dad|ms|m|xml|ini)$"


def _has(name: str) -> Column:
    return F.coalesce(F.bool_or(F.col("file").rlike(FILE_CLASSES[name])), F.lit(False))


def inventory(files: DataFrame) -> DataFrame:
    """One row per run with the kinds of reports it holds; ready with a report or a trace, raw_only without."""
    kinds = F.when(F.col("file").rlike(r"(?i)^report.*\.csv$"), "CSV").when(F.col("file").rlike(r"(?i)^report.*\.txt$"), "TXT").when(
        F.col("file").rlike(r"(?i)^report.*\.xlsx?$"), "XLS"
    )
    return (
        files.groupBy("grp", "sample", "folder")
        .agg(F.array_sort(F.collect_set(kinds)).alias("report_types"), _has("tic_csv").alias("has_tic"), _has("ms_files").alias("has_ms"),
            (_has("ch_files") | _has("uv_files") | _has("ms_files")).alias("has_raw"))
        .withColumn("has_reports", F.size("report_types") > 0)
        .withColumn("ready", F.col("has_reports") | F.col("has_tic"))
        .withColumn("raw_only", F.col("has_raw") & ~F.col("ready"))
    )


def check_files(files: DataFrame, sample_name: str | None = None) -> DataFrame:
    """File names by class and what to do with each run: ready_csv, ready_tic, needs_export or empty."""
    if sample_name:
        files = files.filter(F.col("sample").contains(sample_name))

    def listed(pattern: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(pattern, F.col("file"))))

    classes = {name: listed(F.col("file").rlike(pattern)) for name, pattern in FILE_CLASSES.items()}
    classes["other_files"] = listed(F.col("file").contains(".") & ~F.col("file").rlike(_KNOWN_SUFFIX))
    out = files.groupBy("grp", "sample", "folder").agg(*[c.alias(n) for n, c in classes.items()])

    def some(*names: str) -> Column:
        test = F.lit(False)
        for name in names:
            test = test | (F.size(name) > 0)
        return test

    return out.withColumn(
        "strategy",
        F.when(some("csv_reports", "txt_reports", "xls_reports"), "ready_csv").when(some("tic_csv"), "ready_tic")
        .when(some("ch_files", "uv_files", "ms_files"), "needs_export").otherwise("empty"),
    )


def strategy_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
