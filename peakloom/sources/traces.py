"""Chromatogram traces and scan tables: S6, S13."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from peakloom.sources.reports import number, read_texts
from peakloom.sources.runs import RUN_FILE

DATA_MARK = "Start of data points"


def parse_traces(texts: DataFrame) -> DataFrame:
    """Rows ``rt,intensity`` after the data mark, numbered from 0 per file. ``texts``: path, text."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.struct(i.alias("i"), F.trim(l).alias("line")))
    df = texts.select("path", lines.alias("lines")).withColumn(
        "mark", F.get(F.filter("lines", lambda x: x["line"].startswith(DATA_MARK)), F.lit(0))["i"]
    )
    pairs = F.transform(
        F.filter("lines", lambda x: x["i"] > F.col("mark")),
        lambda x: F.struct(
            number(F.get(F.split(x["line"], ","), F.lit(0))).alias("t"), number(F.get(F.split(x["line"], ","), F.lit(1))).alias("y")
        ),
    )
    good = F.filter(pairs, lambda p: p["t"].isNotNull() & p["y"].isNotNull())
    return df.select("path", F.posexplode(good).alias("idx", "p")).select(
        F.regexp_extract("path", RUN_FILE, 2).alias("grp"), F.regexp_extract("path", RUN_FILE, 3).alias("sample"),
        "path", "idx", F.col("p.t").alias("t"), F.col("p.y").alias("y"),
    )


def read_traces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_traces(read_texts(spark, paths))


def trace_metadata(traces: DataFrame) -> DataFrame:
    """S6 metadata: points, time range and intensity range of each trace."""
    first, last = F.min_by("t", "idx"), F.max_by("t", "idx")
    return traces.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_points"), F.round(first, 3).alias("rt_min"), F.round(last, 3).alias("rt_max"),
        F.round(last - first, 1).alias("total_run_time"), F.max("y").cast("long").alias("max_intensity"),
        F.min("y").cast("long").alias("min_intensity"), F.avg("y").cast("long").alias("mean_intensity"),
    )


def normalise_scans(scans: DataFrame, min_ions: int = 1, seconds: bool = False) -> DataFrame:
    """Ions above 0, scaled to a base peak of 999 and truncated; scans with fewer than ``min_ions`` are dropped.

    ``scans``: sample, scan_rt, peaks (mz, intensity). Times in seconds become minutes with 4 digits.
    """
    kept = F.filter("peaks", lambda p: p["intensity"] > 0)
    out = scans.withColumn("peaks", kept).filter(F.size("peaks") >= min_ions)
    out = out.withColumn("_top", F.array_max(F.transform("peaks", lambda p: p["intensity"].cast("double"))))
    scaled = F.transform(
        "peaks",
        lambda p: F.struct(
            p["mz"].cast("double").alias("mz"), (p["intensity"].cast("double") / F.col("_top") * 999).cast("int").alias("intensity")
        ),
    )
    if seconds:
        out = out.withColumn("scan_rt", F.round(F.col("scan_rt") / 60.0, 4))
    return out.withColumn("peaks", scaled).drop("_top")
