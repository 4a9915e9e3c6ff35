"""Whole analyses as compositions of the operators: report folders, traces with identification, library search, reports.

Each function is lazy apart from the size checks of its operators. A peak is known by (sample, rt); what identifies it first
keeps precedence: vendor hit, spectrum, retention time, label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from peakloom.operators import chrom, compare, correlation, filters, identify, kovats, rtmatch, spectra, stats
from peakloom.operators.samples import with_sample_columns
from peakloom.scale import small_side
from peakloom.session import cut_lineage
from peakloom.sources.ingest import read_reports, summary as ingest_summary
from peakloom.sources.sinks import write_bundle, write_report, write_summary_csv


def component_tables(peaks: DataFrame) -> dict[str, DataFrame]:
    """The numbers behind the component plot: scores, loadings and the ellipses of groups."""
    scores, loadings, _ = correlation.principal_components(peaks, k=2)
    out = {"pca_scores": scores, "pca_loadings": loadings}
    if "pc2" in scores.columns:
        scores = cut_lineage(scores)
        out |= {"pca_scores": scores, "pca_ellipses": correlation.confidence_ellipses(scores)}
    return out


def plot_tables(peaks: DataFrame, components: bool = True) -> dict[str, DataFrame]:
    """The numbers behind the bar, box, composition, heat map, component and dashboard plots."""
    return {
        **(component_tables(peaks) if components else {}),
        "bar": stats.bar_table(peaks),
        "box": stats.boxplot(peaks),
        "composition": stats.composition(peaks),
        "zscores": stats.zscores(peaks),
        "totals": stats.sample_totals(peaks),
        "top_compounds": stats.top_compounds(peaks),
        "top_per_group": stats.top_per_group(peaks),
        "cv_bands": stats.cv_bands(peaks),
        "histogram": stats.histogram(peaks),
        "samples_per_group": stats.samples_per_group(peaks),
    }


def batch_analysis(
    spark: SparkSession, data_dir: str, group_a: str | None = None, group_b: str | None = None, path: str | None = None, kind: str = "parquet"
) -> dict[str, DataFrame]:
    """Report folders to statistics: raw peaks with a summary of what was read, group statistics, composition, plot tables and
    Student's test of two groups. With ``path`` all of it is written, next to the samples x compounds table.

    Without names the first two groups are compared.
    """
    peaks = cut_lineage(read_reports(spark, data_dir))
    out = {
        "raw_data": peaks, "ingest": ingest_summary(spark, data_dir, peaks), "statistics": stats.group_stats(peaks), **plot_tables(peaks),
        "overview": stats.overview(peaks),
    }
    pair = [g for g in (group_a, group_b) if g] or first_groups(peaks)
    if len(pair) == 2:
        out["comparison"] = compare.student_test(peaks, *pair)
    if path is not None:
        write_summary_csv(peaks, f"{path}/summary")
        write_bundle(out, f"{path}/bundle", kind)
    return out


def first_groups(peaks: DataFrame, k: int = 2) -> list[str]:
    return [r["grp"] for r in peaks.select("grp").distinct().orderBy("grp").limit(k).collect()]


def export(peaks: DataFrame, path: str, kind: str = "both") -> None:
    """Summary CSV, table bundle or both."""
    if kind in ("csv", "both"):
        write_summary_csv(peaks, f"{path}/summary")
    if kind in ("bundle", "both"):
        pair = first_groups(peaks)
        tables = {
            "raw_data": peaks, "pivot_long": stats.sample_means(peaks), "statistics": stats.group_stats(peaks), "composition": stats.composition(peaks),
        }
        if len(pair) == 2:
            tables["comparison"] = compare.student_test(peaks, *pair)
        write_bundle(tables, f"{path}/bundle")


def statistical_analysis(peaks: DataFrame, kind: str = "all", pairs: int | None = 15) -> dict[str, DataFrame]:
    """Descriptive statistics, the comparison of the first two groups and the strongest ``pairs`` of correlated compounds
    (None: all above the threshold)."""
    out = {}
    if kind in ("descriptive", "all"):
        out["descriptive"] = stats.descriptive(peaks)
    if kind in ("comparison", "all"):
        pair = first_groups(peaks)
        if len(pair) == 2:
            out["comparison"] = compare.compare_groups(peaks, *pair)
    if kind in ("correlation", "all"):
        out["correlation"] = correlation.strong_pairs(correlation.pearson(peaks), k=pairs)
    return out


def comprehensive_report(
    peaks: DataFrame, group_a: str | None = None, group_b: str | None = None, pairs: int | None = 15
) -> dict[str, DataFrame]:
    """Sections of the full report, with the strongest ``pairs`` of correlated compounds; write them with ``write_report``."""
    pair = [group_a, group_b] if group_a and group_b else first_groups(peaks)
    out = {
        "data_overview": stats.overview(peaks),
        "samples_per_group": stats.samples_per_group(peaks),
        "descriptive_statistics": stats.descriptive(peaks),
        "quality_assessment": stats.quality_score(peaks),
        "correlations": correlation.strong_pairs(correlation.pearson(peaks), k=pairs),
    }
    comparison = None
    if len(pair) == 2:
        comparison = cut_lineage(compare.compare_groups(peaks, *pair))
        out["group_comparison"] = comparison
        out["large_effects"] = comparison.filter(F.abs("cohens_d") > 0.8)
    out["key_findings"] = stats.key_findings(peaks, comparison)
    return out


def save_report(peaks: DataFrame, path: str, group_a: str | None = None, group_b: str | None = None) -> None:
    write_report(comprehensive_report(peaks, group_a, group_b), path)


def peak_queries(peaks: DataFrame, scans: DataFrame, tolerance: float | None = None, min_ions: int = 5) -> DataFrame:
    """Spectrum of each peak from the nearest scan of its sample: sample, rt, query_id, peaks.

    ``scans``: sample, scan_rt, peaks, already normalised.
    """
    at = rtmatch.nearest_scans(peaks, scans) if tolerance is None else rtmatch.scans_within(peaks, scans, tolerance)
    return (
        at.join(scans, ["sample", "scan_rt"])
        .filter(F.size("peaks") >= min_ions)
        .select("sample", "rt", F.concat_ws("|", "sample", F.col("rt").cast("string")).alias("query_id"), "peaks")
    )


def match_spectra(peaks: DataFrame, scans: DataFrame, library: DataFrame, min_match: int = 600) -> DataFrame:
    """Name RT-labelled peaks by their spectrum, where the expected time of the entry is plausible."""
    targets = peaks.filter(F.lower("compound").startswith("rt_") | (F.coalesce(_col(peaks, "match_method"), F.lit("")) == "builtin_library"))
    q = cut_lineage(peak_queries(targets, scans))
    hits = spectra.search(q.select("query_id", "peaks"), library, min_match=min_match)
    expected = small_side(library.select("lib_id", "rt_exp"), 300_000)
    chosen = identify.gate_by_rt(hits.join(expected, "lib_id"), q.select("query_id", "rt"))
    at = q.select("query_id", "sample", "rt")
    return identify.apply_spectral(peaks, chosen.drop("rt").join(at, "query_id"))


def search_libraries(
    peaks: DataFrame, scans: DataFrame, library: DataFrame, min_match: int = 600, target_samples: str | None = None,
    sources: list[str] | None = None,
) -> DataFrame:
    """Name open peaks from the combined libraries, scored in both directions."""
    targets = peaks if "match_method" in peaks.columns else peaks.withColumn("match_method", F.lit(None).cast("string"))
    targets = targets.filter(filters.needs_id())
    if target_samples:
        targets = filters.restrict_samples(targets, target_samples)
    q = cut_lineage(peak_queries(targets, scans))
    hits = spectra.search_manager(q.select("query_id", "peaks"), library, min_match=min_match, sources=sources)
    chosen = identify.gate_by_rt(hits, q.select("query_id", "rt"), tiers="manager")
    method = F.concat(F.lit("public_library_"), F.col("source"))
    return identify.apply_spectral(
        peaks, chosen.drop("rt").join(q.select("query_id", "sample", "rt"), "query_id"), method, "public_library_match"
    )


def identify_with_ri(
    peaks: DataFrame, scans: DataFrame, library: DataFrame, ri_ref: DataFrame, rt_library: DataFrame | None = None,
    compound_name: str | None = None, spread: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Spectrum and index together: (peaks with accepted names, ranked matches per peak).

    A named compound without a usable scan takes the ions of the retention-time table at full intensity. ``spread`` carries
    an accepted name to all samples at the same time.
    """
    name = F.lower("compound")
    wanted = name.contains(compound_name.lower()) if compound_name else name.startswith("rt_")
    ri = _col(peaks, "ri", "double")
    targets = peaks.filter(wanted).select("sample", "rt", "compound", F.when((ri > 0) & (ri <= 5000), ri).alias("ri_measured")).distinct()
    found = peak_queries(targets, scans)
    q = targets.join(found, ["sample", "rt"], "left")
    if rt_library is not None:
        ions = F.transform("ions", lambda m: F.struct(m.cast("double").alias("mz"), F.lit(999).alias("intensity")))
        table = small_side(rt_library.select(F.lower("name").alias("_key"), ions.alias("_ions")))
        q = q.join(table, F.lower("compound") == F.col("_key"), "left").withColumn("peaks", F.coalesce("peaks", "_ions")).drop("_key", "_ions")
    q = q.filter(F.col("peaks").isNotNull()).withColumn("query_id", F.concat_ws("|", "sample", F.col("rt").cast("string")))
    q = cut_lineage(q.dropDuplicates(["query_id"]))
    matches = cut_lineage(identify.identify(q.select("query_id", "peaks", "ri_measured"), library, ri_ref, k=5))
    best = matches.filter((F.col("rank") == 1) & F.col("confidence").isin("confirmed", "high")).join(q.select("query_id", "sample", "rt"), "query_id")
    if spread:
        accepted = best.select(F.struct("sample", "rt").alias("target_seq"), "rt", "name", "combined_score", "confidence", "ri_diff")
        return rtmatch.spread_identifications(peaks, accepted), matches
    method = F.concat(F.lit("ms_ri_dual_"), F.col("confidence"))
    chosen = best.withColumn("match_factor", F.col("combined_score"))
    return identify.apply_spectral(peaks, chosen, method, "ms_ri"), matches


def calibrate_ri(
    peaks: DataFrame, ri_ref: DataFrame | None = None, alkane_sample: str | None = None, start: int = 8, end: int = 30, window: float = 50.0
) -> dict[str, DataFrame]:
    """Retention indices of all peaks from the alkanes of a standard run: ``peaks`` with ri, the ``anchors``, and with a
    reference table the ``cross_reference`` of names by their index."""
    # at most one anchor per carbon number
    points = cut_lineage(kovats.anchors(peaks, alkane_sample, start, end))
    out = {"peaks": kovats.calibrate(peaks, points), "anchors": points}
    if ri_ref is not None:
        out["cross_reference"] = kovats.cross_reference(out["peaks"], ri_ref, window)
    return out


def identify_or_hint(
    peaks: DataFrame, scans: DataFrame, library: DataFrame, ri_ref: DataFrame, rt_library: DataFrame | None = None,
    compound_name: str | None = None, spread: bool = False, k: int = 5,
) -> dict[str, DataFrame]:
    """``identify_with_ri``, and for the wanted peaks that nothing could be matched for, the library names that hold their
    label: ``peaks``, ``matches``, ``hints``."""
    named, matches = identify_with_ri(peaks, scans, library, ri_ref, rt_library, compound_name, spread)
    label = F.lower("compound")
    wanted = label.contains(compound_name.lower()) if compound_name else label.startswith("rt_")
    key = F.concat_ws("|", "sample", F.col("rt").cast("string"))
    without = peaks.filter(wanted).withColumn("query_id", key).join(matches.select("query_id").distinct(), "query_id", "left_anti")
    return {"peaks": named, "matches": matches, "hints": name_hints(without, library, k)}


def name_hints(peaks: DataFrame, library: DataFrame, k: int = 5) -> DataFrame:
    """Library names that contain the label of a peak, for peaks without ions; richest spectra first."""
    from pyspark.sql import Window as W

    label = F.replace(F.replace(F.lower("compound"), F.lit("rt_"), F.lit("")), F.lit(" "), F.lit(""))
    names = peaks.select(label.alias("name")).distinct()
    entries = library.select(F.col("name").alias("ref_name"), F.size("peaks").alias("n_peaks")).groupBy("ref_name").agg(F.max("n_peaks").alias("n_peaks"))
    pairs = kovats.name_pairs(names, entries).filter(F.contains("ref_name", "name")).join(small_side(entries), "ref_name")
    order = W.partitionBy("name").orderBy(F.col("ref_name") != F.col("name"), F.desc("n_peaks"), "ref_name")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _col(df: DataFrame, name: str, kind: str = "string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def trace_analysis(
    tic: DataFrame, runs: DataFrame, scans: DataFrame | None = None, library: DataFrame | None = None,
    rt_library: DataFrame | None = None, vendor_hits: DataFrame | None = None, report_peaks: DataFrame | None = None,
    min_match: int = 600, rt_tolerance: float = 0.03, **peak_options,
) -> DataFrame:
    """Traces to a filtered, identified peak table: detect, align, vendor hits, spectra, retention time, default filter.

    ``runs``: sample, grp. ``report_peaks`` of runs that only have reports are added before identification.
    """
    found = chrom.detect_peaks(tic, **peak_options)
    aligned = chrom.align_by_rt(cut_lineage(found), rt_tolerance).join(small_side(runs.select("sample", "grp").distinct()), "sample", "left")
    peaks = aligned.select(
        "grp", "sample", "compound", "rt", "area", "height", F.col("area").alias("amount"), F.col("area_pct").alias("conc"), "cluster_id",
    )
    if report_peaks is not None:
        peaks = peaks.unionByName(report_peaks, allowMissingColumns=True)
    peaks = peaks.withColumns({"match_factor": F.lit(None).cast("int"), "match_scale": F.lit(None).cast("int"), "match_method": F.lit(None).cast("string")})
    peaks = cut_lineage(with_sample_columns(peaks))
    if vendor_hits is not None:
        peaks = cut_lineage(rtmatch.merge_vendor_hits(peaks, vendor_hits))
    if scans is not None and library is not None:
        peaks = cut_lineage(match_spectra(peaks, scans, library, min_match))
    if rt_library is not None:
        peaks = rtmatch.match_rt_library(peaks, rt_library)
    return filters.default_filter(peaks)
