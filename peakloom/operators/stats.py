"""Descriptive statistics of the peak table: A1-A4, A12-A23, A30, W5.

Columns used: grp, sample, compound, rt, area, conc. A null compound carries no statistics and is left out, like a null
key in a grouped table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.scale import quantiles, small_side

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _named(peaks: DataFrame) -> DataFrame:
    return peaks.filter(F.col("compound").isNotNull())


def _cv(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, std / F.nullif(mean, F.lit(0.0)) * 100).otherwise(F.lit(0.0))


def group_stats(peaks: DataFrame) -> DataFrame:
    """A1: mean, sample deviation, CV%, range and row count per group and compound."""
    mean, std = F.avg("conc"), F.stddev_samp("conc")
    return (
        _named(peaks)
        .groupBy("grp", "compound")
        .agg(
            mean.alias("mean"),
            std.alias("std"),
            F.min("conc").alias("min"),
            F.max("conc").alias("max"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("cv_pct", _cv(F.col("mean"), F.col("std")))
    )


def bar_table(peaks: DataFrame) -> DataFrame:
    """The numbers behind a bar chart with error bars."""
    return group_stats(peaks).select("compound", "grp", "mean", "std", "n")


def descriptive(peaks: DataFrame) -> DataFrame:
    """A2: per compound n, mean, deviation, CV%, range, median and quartiles."""
    base = _named(peaks)
    moments = (
        base.groupBy("compound")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("conc").alias("mean"),
            F.stddev_samp("conc").alias("std"),
            F.min("conc").alias("min"),
            F.max("conc").alias("max"),
        )
        .withColumn("cv_pct", _cv(F.col("mean"), F.col("std")))
    )
    return moments.join(quantiles(base, ["compound"], "conc", QUARTILES), "compound", "left")


def sample_means(peaks: DataFrame, keys: Sequence[str] = ("grp", "sample")) -> DataFrame:
    """Long form of the samples x compounds table: mean concentration per cell."""
    return _named(peaks).groupBy(*keys, "compound").agg(F.avg("conc").alias("conc"))


def pivot_mean(peaks: DataFrame, compounds: Sequence[str] | None = None) -> DataFrame:
    """A3: samples x compounds, sorted. Name the compounds to keep the schema stable and save the distinct pass."""
    grouped = _named(peaks).groupBy("grp", "sample")
    pivoted = grouped.pivot("compound", list(compounds)) if compounds else grouped.pivot("compound")
    return pivoted.agg(F.avg("conc")).orderBy("grp", "sample")


def composition(peaks: DataFrame) -> DataFrame:
    """A4: share of each compound in the total of its sample, in percent."""
    cells = sample_means(peaks)
    totals = cells.groupBy("grp", "sample").agg(F.sum("conc").alias("total"))
    return cells.join(totals, ["grp", "sample"]).select(
        "grp", "sample", "compound", "conc", F.round(F.try_divide("conc", "total") * 100, 2).alias("pct")
    )


def sample_totals(peaks: DataFrame) -> DataFrame:
    """Total concentration per sample, largest first."""
    return peaks.groupBy("grp", "sample").agg(F.sum("conc").alias("total")).orderBy(F.desc("total"), "sample")


def overview(peaks: DataFrame) -> DataFrame:
    """One row of counts and the concentration range."""
    return peaks.agg(
        F.countDistinct("sample").alias("samples"),
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("compound").alias("compounds"),
        F.countDistinct("grp").alias("groups"),
        F.min("conc").alias("conc_min"),
        F.max("conc").alias("conc_max"),
        F.avg("conc").alias("conc_mean"),
    )


def samples_per_group(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("grp").agg(F.countDistinct("sample").alias("samples"))


def top_compounds(peaks: DataFrame, k: int = 8) -> DataFrame:
    """Mean per group of the k compounds with the largest overall mean."""
    top = (
        _named(peaks).groupBy("compound").agg(F.avg("conc").alias("overall"))
        .orderBy(F.desc("overall"), "compound").limit(k)
    )
    # k rows at most, so the broadcast has a fixed size
    return (
        peaks.join(F.broadcast(top), "compound")
        .groupBy("grp", "compound")
        .agg(F.avg("conc").alias("mean"))
    )


def top_per_group(peaks: DataFrame, k: int = 3) -> DataFrame:
    """The k largest mean concentrations of every group."""
    means = _named(peaks).groupBy("grp", "compound").agg(F.avg("conc").alias("mean"))
    order = W.partitionBy("grp").orderBy(F.desc("mean"), "compound")
    return means.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cv_table(peaks: DataFrame) -> DataFrame:
    """CV% per compound with positive mean."""
    return (
        _named(peaks)
        .groupBy("compound")
        .agg(F.avg("conc").alias("mean"), F.stddev_samp("conc").alias("std"))
        .filter(F.col("mean") > 0)
        .select("compound", (F.col("std") / F.col("mean") * 100).alias("cv_pct"))
    )


def cv_bands(peaks: DataFrame) -> DataFrame:
    """CV% with the colour bands of the dashboard."""
    cv = F.col("cv_pct")
    band = F.when(cv > 50, "high").when(cv > 25, "medium").otherwise("low")
    return cv_table(peaks).withColumn("band", band)


def cv_stats(peaks: DataFrame) -> DataFrame:
    """Mean and median CV%, number above 50 and below 25, on CV% rounded to one digit."""
    cvs = cv_table(peaks).select(F.round("cv_pct", 1).alias("cv_pct"))
    middle = quantiles(cvs, [], "cv_pct", {"median_cv": 0.5}).scalar()
    return cvs.agg(
        F.round(F.avg("cv_pct"), 1).alias("mean_cv"),
        F.count_if(F.col("cv_pct") > 50).alias("high_cv_count"),
        F.count_if(F.col("cv_pct") < 25).alias("low_cv_count"),
    ).select("mean_cv", F.round(middle, 1).alias("median_cv"), "high_cv_count", "low_cv_count")


def missing_rate(peaks: DataFrame) -> DataFrame:
    """Share of samples without a value, for compounds that miss at least one."""
    cells = sample_means(peaks)
    rows = cells.select("grp", "sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        cells.groupBy("compound")
        .agg(F.count("conc").alias("present"))
        .withColumn("missing_pct", F.round((1 - F.col("present") / rows) * 100, 1))
        .filter(F.col("present") < rows)
        .select("compound", "missing_pct")
    )


def _fences(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    quart = quantiles(peaks, keys, "conc", QUARTILES)
    iqr = F.col("q75") - F.col("q25")
    return quart.select(*keys, *QUARTILES, (F.col("q25") - 1.5 * iqr).alias("lower"), (F.col("q75") + 1.5 * iqr).alias("upper"))


def iqr_outliers(peaks: DataFrame) -> DataFrame:
    """Values outside 1.5 IQR per group, over group x compound cells with at least 4 rows and a positive IQR."""
    base = _named(peaks).select("grp", "compound", "conc")
    keys = ["grp", "compound"]
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    fences = (
        _fences(base, keys).join(sizes, keys)
        .filter((F.col("rows") >= 4) & (F.col("q75") > F.col("q25")))
        .select(*keys, "lower", "upper")
    )
    fences = small_side(fences, proof=base.select(*keys).distinct())
    outside = (F.col("conc") < F.col("lower")) | (F.col("conc") > F.col("upper"))
    return base.join(fences, keys, "left").groupBy("grp").agg(F.count_if(outside).alias("outliers"))


def quality_score(peaks: DataFrame) -> DataFrame:
    """One row with issue counts, score and warnings."""
    missing = missing_rate(peaks).agg(F.count(F.lit(1)).alias("n")).scalar()
    cv = cv_stats(peaks)
    outliers = iqr_outliers(peaks).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("n")).scalar()
    compounds = _named(peaks).agg(F.countDistinct("compound").alias("n")).scalar()
    out = cv.select(
        "mean_cv", "median_cv", "high_cv_count", "low_cv_count",
        missing.alias("n_missing"), outliers.alias("n_outliers"), compounds.alias("n_compounds"),
    )
    issues = F.col("n_missing") * 2 + F.col("high_cv_count") * 1.5 + F.col("n_outliers") * 0.5
    n = F.col("n_compounds")
    return (
        out.withColumn("total_issues", issues.cast("double"))
        .withColumn(
            "overall_score",
            F.when(F.col("total_issues") < n * 0.5, "good").when(F.col("total_issues") < n * 1.5, "fair").otherwise("poor"),
        )
        .withColumn(
            "warnings",
            F.concat_ws(
                "; ",
                F.when(F.col("n_missing") > 0, F.format_string("%d compounds have missing values", "n_missing")),
                F.when(F.col("high_cv_count") > 0, F.format_string("%d compounds have CV%% > 50", "high_cv_count")),
                F.when(F.col("n_outliers") > 0, F.format_string("%d IQR outliers", "n_outliers")),
            ),
        )
    )


def histogram(peaks: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of conc in equal bins over the range of each group; empty bins are not listed."""
    values = peaks.filter(F.col("conc").isNotNull()).select("grp", "conc")
    ranges = values.groupBy("grp").agg(F.min("conc").alias("lo"), F.max("conc").alias("hi"))
    ranges = small_side(ranges, proof=values.select("grp").distinct())
    span = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    slot = F.floor((F.col("conc") - F.col("lo")) / span * bins)
    return (
        values.join(ranges, "grp")
        # a group with one value spans +-0.5 around it, which puts everything in the middle bin
        .select("grp", F.least(F.coalesce(slot, F.lit(bins // 2)), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("grp", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def boxplot(peaks: DataFrame, keys: Sequence[str] = ("grp", "compound")) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR and the number of values beyond them.

    The values beyond the whiskers are listed by ``boxplot_outliers``: as rows, since one key may have very many.
    """
    base, fences, keys = _box_parts(peaks, keys)
    inside = F.col("conc").between(F.col("lower"), F.col("upper"))
    return (
        base.join(fences, keys)
        .groupBy(*keys)
        .agg(
            *[F.first(q).alias(q) for q in QUARTILES],
            F.min(F.when(inside, F.col("conc"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("conc"))).alias("whisker_hi"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def boxplot_outliers(peaks: DataFrame, keys: Sequence[str] = ("grp", "compound")) -> DataFrame:
    base, fences, keys = _box_parts(peaks, keys)
    return base.join(fences, keys).filter(~F.col("conc").between(F.col("lower"), F.col("upper"))).select(*keys, "conc")


def _box_parts(peaks: DataFrame, keys: Sequence[str]):
    keys = list(keys)
    base = _named(peaks).filter(F.col("conc").isNotNull()).select(*keys, "conc")
    return base, small_side(_fences(base, keys), proof=base.select(*keys).distinct()), keys


def _moments_by_compound(cells: DataFrame) -> DataFrame:
    stats = cells.groupBy("compound").agg(F.avg("conc").alias("m"), F.stddev_samp("conc").alias("s"))
    return small_side(stats, proof=cells.select("compound").distinct())


def zscores(peaks: DataFrame) -> DataFrame:
    """Z-score of every present cell over the samples of its compound."""
    cells = sample_means(peaks)
    return cells.join(_moments_by_compound(cells), "compound").select(
        "grp", "sample", "compound", F.try_divide(F.col("conc") - F.col("m"), F.col("s")).alias("z")
    )


def zscore_matrix(peaks: DataFrame, compounds: Sequence[str]) -> DataFrame:
    """A23 dense form: one row per sample, a missing or constant cell is 0."""
    pivoted = zscores(peaks).groupBy("grp", "sample").pivot("compound", list(compounds)).agg(F.max("z"))
    return pivoted.fillna(0.0, subset=list(compounds))


def anomalies(peaks: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Cells further than ``threshold`` deviations from the mean of their compound; compounds without spread skipped."""
    cells = sample_means(peaks, ["sample"])
    z = (F.col("conc") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    return (
        cells.join(_moments_by_compound(cells), "compound")
        .withColumn("z", z)
        .filter(F.abs("z") > threshold)
        .select("sample", "compound", F.col("conc").alias("value"), F.col("z").alias("z_score"))
    )


def anomaly_summary(found: DataFrame, k: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals, the k strongest cells and the affected samples."""
    totals = found.agg(F.count(F.lit(1)).alias("total_anomalies"), F.countDistinct("sample").alias("affected_samples"))
    top = found.orderBy(F.desc(F.abs("z_score")), "sample", "compound").limit(k)
    return totals, top, found.select("sample").distinct()


def key_findings(
    peaks: DataFrame, comparison: DataFrame | None = None, abundant: int = 5, variable: int = 3, different: int = 8
) -> DataFrame:
    """The largest means, the largest CV% and, with a comparison, its most significant compounds, one row per entry; so
    many of each as asked for."""
    means = (
        _named(peaks).groupBy("compound").agg(F.avg("conc").alias("mean"), F.stddev_samp("conc").alias("std"))
    )
    by_mean = means.orderBy(F.desc("mean"), "compound").limit(abundant).select(
        F.lit("most_abundant").alias("finding"), "compound", F.col("mean").alias("value")
    )
    cv = F.coalesce(F.try_divide("std", "mean") * 100, F.lit(0.0))
    by_cv = means.select("compound", cv.alias("value")).orderBy(F.desc("value"), "compound").limit(variable).select(
        F.lit("most_variable").alias("finding"), "compound", "value"
    )
    out = by_mean.unionByName(by_cv)
    if comparison is not None:
        out = out.unionByName(
            comparison.filter(F.col("significant") != "ns").orderBy("p_value_t", "compound").limit(different).select(
                F.lit("group_difference").alias("finding"), "compound", F.col("cohens_d").alias("value")
            )
        )
    return out
