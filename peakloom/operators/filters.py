"""Row filters over the peak table and the library: F1-F12."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Name parts that mark column bleed and plasticisers, and the classes kept by default.
CONTAMINANTS = ["siloxane", "exclude", "column bleed", "phthalate"]
KEPT_CLASSES = ["food_flavor", "natural_product", "other"]


def min_area(peaks: DataFrame, area: float) -> DataFrame:
    """F1."""
    return peaks.filter(F.col("area") >= area)


def min_match(peaks: DataFrame, match: float) -> DataFrame:
    """keep unmatched peaks and matches of at least ``match`` percent.

    Vendor factors run to 100 and spectral ones to 999; where ``match_scale`` names the range, the factor is brought to 100.
    """
    factor = F.col("match_factor").cast("double")
    if "match_scale" in peaks.columns:
        factor = F.when(F.col("match_scale") == 999, factor * 100 / 999).otherwise(factor)
    return peaks.filter(F.col("match_factor").isNull() | (factor >= match))


def identified(peaks: DataFrame) -> DataFrame:
    """F3."""
    return peaks.filter(F.col("compound").isNotNull() & ~F.col("compound").rlike("^(RT_|rt_)"))


def _has_any(name: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.lower(name).contains(part)
    return hit


def without_contaminants(peaks: DataFrame, parts: Sequence[str] = CONTAMINANTS) -> DataFrame:
    """a null name is kept."""
    return peaks.filter(F.coalesce(~_has_any(F.col("compound"), parts), F.lit(True)))


def _parts(text: str) -> list[str]:
    return [p.strip().lower() for p in text.split(",") if p.strip()]


def include_compounds(peaks: DataFrame, names: str) -> DataFrame:
    """a null name is dropped; an empty list keeps everything."""
    parts = _parts(names)
    return peaks.filter(F.coalesce(_has_any(F.col("compound"), parts), F.lit(False))) if parts else peaks


def exclude_compounds(peaks: DataFrame, names: str) -> DataFrame:
    """a null name is kept."""
    parts = _parts(names)
    return peaks.filter(F.coalesce(~_has_any(F.col("compound"), parts), F.lit(True))) if parts else peaks


def filter_data(
    peaks: DataFrame,
    area: float | None = None,
    match: float | None = None,
    exclude_unidentified: bool = False,
    exclude_contaminants: bool = False,
    include: str | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """All filters of the peak table in one call; the predicates meet in one pass over the data."""
    if area:
        peaks = min_area(peaks, area)
    if match:
        peaks = min_match(peaks, match)
    if exclude_unidentified:
        peaks = identified(peaks)
    if exclude_contaminants:
        peaks = without_contaminants(peaks)
    if include:
        peaks = include_compounds(peaks, include)
    if exclude:
        peaks = exclude_compounds(peaks, exclude)
    return peaks


def default_filter(peaks: DataFrame) -> DataFrame:
    """F7."""
    return filter_data(peaks, area=10000, match=70)


def default_filter_counts(peaks: DataFrame) -> DataFrame:
    """rows removed by each step, from one pass."""
    small = F.coalesce(F.col("area") < 10000, F.lit(True))
    weak = F.coalesce(F.col("match_factor") < 70, F.lit(False))
    return peaks.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(small).alias("area_filtered"),
        F.count_if(~small & weak).alias("match_filtered"),
        F.count_if(~small & ~weak).alias("rows_after"),
    )


def filter_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """F8: rows, compounds and samples on both sides."""

    def counts(df: DataFrame, side: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("records"),
            F.countDistinct("compound").alias("compounds"),
            F.countDistinct("sample").alias("samples"),
        ).select(F.lit(side).alias("side"), "records", "compounds", "samples")

    return counts(before, "before").unionByName(counts(after, "after"))


def top_by_area(peaks: DataFrame, k: int = 10) -> DataFrame:
    """F8: compounds with the largest mean area."""
    return (
        peaks.filter(F.col("compound").isNotNull()).groupBy("compound").agg(F.avg("area").alias("mean_area"))
        .orderBy(F.desc("mean_area"), "compound").limit(k)
    )


def filter_library(library: DataFrame, allowed: Sequence[str] = KEPT_CLASSES, min_confidence: float = 0.3) -> DataFrame:
    """F9."""
    return library.filter(
        F.coalesce("compound_class", F.lit("other")).isin(list(allowed))
        & (F.coalesce("class_confidence", F.lit(0.0)) >= min_confidence)
    )


def usable_entries(library: DataFrame, min_peaks: int = 3) -> DataFrame:
    """at least 3 ions for the library manager, 2 for the fast search."""
    return library.filter(F.size("peaks") >= min_peaks)


def restrict_samples(peaks: DataFrame, samples: str) -> DataFrame:
    """samples whose name contains any of a comma list; empty parts of the list match nothing."""
    wanted = F.lit(False)
    for part in [p.strip() for p in samples.split(",") if p.strip()]:
        wanted = wanted | F.col("sample").contains(part)
    return peaks.filter(wanted)


def restrict_sources(library: DataFrame, sources: Sequence[str] | None) -> DataFrame:
    """F11."""
    return library.filter(F.col("source").isin(list(sources))) if sources else library


def needs_id() -> Column:
    """peaks open to (re-)identification: RT labels, no name, or named by retention time only."""
    name = F.lower(F.coalesce("compound", F.lit("")))
    return (
        name.startswith("rt_") | name.isin("", "nan") | (F.coalesce("match_method", F.lit("")) == "builtin_library")
    )
