"""Two-group comparison: A5-A10, J11, W1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.functions.pvalues import mann_whitney_p, student_p
from peakloom.scale import order_bucket, ordered_totals
from peakloom.session import cut_lineage


def _two_groups(peaks: DataFrame, group_a: str, group_b: str) -> DataFrame:
    return peaks.filter(
        F.col("grp").isin(group_a, group_b) & F.col("conc").isNotNull() & F.col("compound").isNotNull()
    ).select("compound", "conc", (F.col("grp") == group_a).alias("is_a"))


def _moments(values: DataFrame) -> DataFrame:
    """Compounds with at least two values in both groups, with the moments of each."""
    a, b = F.when(F.col("is_a"), F.col("conc")), F.when(~F.col("is_a"), F.col("conc"))
    return (
        values.groupBy("compound")
        .agg(
            F.count(a).alias("n_a"), F.count(b).alias("n_b"),
            F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
            F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"),
        )
        .filter((F.col("n_a") >= 2) & (F.col("n_b") >= 2))
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def _t(difference: Column, error: Column) -> Column:
    # no spread in either group: an infinite statistic when the means differ, undefined when they agree
    return F.when(error > 0, difference / F.nullif(error, F.lit(0.0))).when(
        difference != 0, F.signum(difference) * F.lit(float("inf"))
    )


def student_test(peaks: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """A5: Student's t-test with pooled variance per compound, stars on the raw p."""
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("var_a"), F.col("var_b")
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    out = _moments(_two_groups(peaks, group_a, group_b)).select(
        "compound", "mean_a", "mean_b",
        _t(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled * (1 / na + 1 / nb))).alias("t_statistic"),
        (na + nb - 2).cast("double").alias("df"),
    )
    return out.withColumn("p_value", student_p("t_statistic", "df")).withColumn("significant", stars(F.col("p_value")))


def rank_sums(peaks: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """A7 statistics: U of group a and the tie term, from counts of equal values.

    Every value of a beats the smaller values of b and half-beats the equal ones, so U needs only running counts.
    """
    counts = (
        _two_groups(peaks, group_a, group_b)
        .groupBy("compound", "conc")
        .agg(F.count_if(F.col("is_a")).alias("a"), F.count_if(~F.col("is_a")).alias("b"))
    )
    tied = (F.col("a") + F.col("b")).cast("double")
    return (
        ordered_totals(counts, ["compound"], "conc", ["a", "b"])
        .groupBy("compound")
        .agg(
            F.sum(F.col("a") * (F.col("b_before") + F.col("b") * 0.5)).alias("u"),
            F.sum(tied * tied * tied - tied).alias("tie_term"),
            F.max("a_total").alias("n_a"),
            F.max("b_total").alias("n_b"),
        )
        .filter((F.col("n_a") >= 2) & (F.col("n_b") >= 2))
    )


def mann_whitney(peaks: DataFrame, group_a: str, group_b: str) -> DataFrame:
    return rank_sums(peaks, group_a, group_b).withColumn("p_value", mann_whitney_p("u", "n_a", "n_b", "tie_term"))


def adjust_fdr(df: DataFrame, p: str, out: str = "p_value_fdr") -> DataFrame:
    """Benjamini-Hochberg over all rows with a p.

    Equal p-values share one adjusted value, so the ordering runs over distinct p-values with their counts. The running
    minimum from the largest p down is taken inside value buckets, then against the minimum of the buckets above.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("m"))
    ranked = ordered_totals(counts, [], p, ["m"]).select(
        p,
        order_bucket(F.col(p)).alias("_bucket"),
        (F.col(p) * F.col("m_total") / (F.col("m_before") + F.col("m"))).alias("_q"),
    )
    down = W.partitionBy("_bucket").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy(F.lit(0)).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    per_bucket = ranked.groupBy("_bucket").agg(F.min("_q").alias("_q_min"))
    per_bucket = per_bucket.select("_bucket", F.min("_q_min").over(above).alias("_q_above"))
    adjusted = (
        ranked.withColumn("_q_in", F.min("_q").over(down))
        .join(per_bucket, "_bucket")
        .select(p, F.least(F.lit(1.0), F.col("_q_in"), F.col("_q_above")).alias(out))
    )
    return df.join(adjusted, p, "left")


def compare_groups(peaks: DataFrame, group_a: str, group_b: str, rank_test: bool = True) -> DataFrame:
    """Welch's test, Mann-Whitney p, fold change, Cohen's d and FDR stars per common compound."""
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("var_a"), F.col("var_b")
    sa, sb = va / na, vb / nb
    difference = F.col("mean_a") - F.col("mean_b")
    freedom = (sa + sb) * (sa + sb) / F.nullif(sa * sa / (na - 1) + sb * sb / (nb - 1), F.lit(0.0))
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    d = F.when(pooled > 0, difference / F.nullif(pooled, F.lit(0.0))).otherwise(F.lit(0.0))
    fold = F.when(F.col("mean_b") > 0, F.col("mean_a") / F.nullif(F.col("mean_b"), F.lit(0.0)))
    out = (
        _moments(_two_groups(peaks, group_a, group_b))
        .withColumn("fold_change", fold)
        .withColumn("log2_fc", F.when(F.col("fold_change") > 0, F.log2("fold_change")))
        .withColumn("cohens_d", d)
        .withColumn(
            "effect_size",
            F.when(F.abs("cohens_d") > 0.8, "large").when(F.abs("cohens_d") > 0.5, "medium").otherwise("small"),
        )
        .withColumn("t_statistic", _t(difference, F.sqrt(sa + sb)))
        .withColumn("df", F.coalesce(freedom, (na + nb - 2).cast("double")))
        .withColumn("p_value_t", student_p("t_statistic", "df"))
    )
    # one row per compound, read several times by the adjustment
    out = cut_lineage(out)
    out = adjust_fdr(out, "p_value_t").withColumn("significant", stars(F.col("p_value_fdr")))
    columns = [
        "compound", "n_a", "n_b", "mean_a", "mean_b", "fold_change", "log2_fc", "cohens_d", "effect_size",
        "t_statistic", "p_value_t", "p_value_fdr", "significant",
    ]
    if rank_test:
        ranks = mann_whitney(peaks, group_a, group_b).select("compound", F.col("p_value").alias("p_value_mwu"))
        out = out.join(ranks, "compound", "left")
        columns.append("p_value_mwu")
    return out.select(*columns)


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """A9."""
    return comparison.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.col("p_value_t") < 0.05).alias("significant_raw"),
        F.count_if(F.col("significant") != "ns").alias("significant_fdr"),
    )


def top_significant(comparison: DataFrame, k: int = 10) -> DataFrame:
    return comparison.filter(F.col("significant") != "ns").orderBy("p_value_t", "compound").limit(k)


def volcano(comparison: DataFrame, p_threshold: float = 0.05, fold_threshold: float = 1.5) -> DataFrame:
    """A10: volcano coordinates and direction; a missing fold change counts as no change."""
    log_fold = F.coalesce("log2_fc", F.lit(0.0))
    height = -F.log10(F.greatest(F.col("p_value_t"), F.lit(1e-300)))
    limit = F.log2(F.lit(float(fold_threshold)))
    hit = F.col("neg_log10_p") > -F.log10(F.lit(float(p_threshold)))
    return comparison.select("compound", log_fold.alias("log2_fc"), height.alias("neg_log10_p"), "p_value_t").withColumn(
        "direction",
        F.when(hit & (F.col("log2_fc") > limit), "up").when(hit & (F.col("log2_fc") < -limit), "down").otherwise("ns"),
    )


def volcano_labels(points: DataFrame, k: int = 5) -> DataFrame:
    """The k most significant compounds of each direction."""
    order = W.partitionBy("direction").orderBy(F.desc("neg_log10_p"), "compound")
    return (
        points.filter(F.col("direction") != "ns")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def result_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Mean per compound of two result sets, relative difference in percent and a verdict."""
    a = new.groupBy("compound").agg(F.avg("conc").alias("mean_new"))
    b = old.groupBy("compound").agg(F.avg("conc").alias("mean_old"))
    gap = F.abs(F.col("mean_new") - F.col("mean_old")) / F.nullif(F.abs("mean_old"), F.lit(0.0)) * 100
    return (
        a.join(b, "compound")
        .withColumn("diff_pct", F.coalesce(gap, F.when(F.col("mean_new") == F.col("mean_old"), 0.0)))
        .withColumn("verdict", F.when(F.col("diff_pct") < 0.1, "OK").when(F.col("diff_pct") < 1, "WARN").otherwise("FAIL"))
    )
