"""Named queries over the derived views, each with its check SQL.

A check is written against the definition of the result, not against the way it is computed here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from peakloom.operators import (
    chrom, compare, correlation, enrichment, filters, identify, kovats, library as lib_ops, rtmatch, samples, spectra, stats,
)
from peakloom.plans import views as v
from peakloom.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, uses: tuple[str, ...] = ("peaks",)):
    """Register a query; ``uses`` names the views its check reads."""

    def add(build):
        QUERIES[name] = build
        if check:
            with_views = ",\n".join(f"{u} AS ({_check_source(u)})" for u in uses)
            text = check.strip()
            head = "WITH RECURSIVE " if text.startswith("WITH RECURSIVE ") else "WITH "
            glue = ", " if text.startswith("WITH ") else " "
            CHECKS[name] = f"{head}{with_views}{glue}{text[len(head):] if glue == ', ' else text}" if uses else text
        return build

    return add


# Views that only checks and queries of this catalogue need.
_EXTRA = {
    "named_peaks": """
SELECT lower(p_name) AS compound, CAST(401 + l_partkey * 97 % 3500 + l_linenumber AS DOUBLE) AS ri,
       concat('Sample', lpad(CAST(l_suppkey AS STRING), 4, '0'), '.D') AS sample
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "standards": """
SELECT concat('Sample', lpad(CAST(l_suppkey AS STRING), 4, '0'), '.D') AS sample, l_extendedprice AS area,
       concat('c', CAST(8 + p_size % 23 AS STRING)) AS compound,
       2 + CAST((l_partkey * l_partkey * 31 + l_partkey * 17) % 30011 AS DOUBLE) / 1000 AS rt
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "vendor_hits": """
SELECT concat('Sample', lpad(CAST(l_suppkey AS STRING), 4, '0'), '.D') AS sample,
       CAST(1 + l_linenumber % 2 AS INT) AS file_priority, concat('hits', CAST(l_linenumber % 2 AS STRING), '.csv') AS file,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS BIGINT) AS hit_seq,
       2 + CAST((l_partkey * l_partkey * 31 + l_partkey * 17) % 30011 AS DOUBLE) / 1000 + CAST(l_orderkey % 90 - 45 AS DOUBLE) / 1000 AS rt,
       CASE WHEN p_size < 5 THEN 'Unknown' ELSE p_name END AS compound,
       CAST(l_quantity * 2 - 20 AS INT) AS match_factor, CAST(l_quantity * 2 - 30 AS INT) AS reverse_match,
       CASE WHEN p_size < 20 THEN '' ELSE concat('C', CAST(p_size AS STRING)) END AS formula,
       CASE WHEN p_size < 30 THEN '' ELSE concat(CAST(p_size AS STRING), '-00-1') END AS cas
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "scan_times": """
SELECT DISTINCT concat('Sample', lpad(CAST(l_suppkey AS STRING), 4, '0'), '.D') AS sample,
       2 + CAST((l_partkey * l_partkey * 17 + l_partkey * 5) % 30011 AS DOUBLE) / 1000 AS scan_rt
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "odd_names": """
SELECT DISTINCT name FROM (
  SELECT p_name AS name FROM part UNION ALL SELECT concat(p_name, ' ', lower(p_type)) AS name FROM part
  UNION ALL SELECT substr(p_name, 2, 5) AS name FROM part) n""",
    "accepted_ids": """
SELECT CAST(p_partkey AS BIGINT) AS target_seq,
       2 + CAST((p_partkey * p_partkey * 31 + p_partkey * 17) % 30011 AS DOUBLE) / 1000 + 0.004 AS rt, p_name AS name,
       CAST(800 + p_size * 3 AS INT) AS combined_score,
       CASE WHEN p_size < 20 THEN 'confirmed' WHEN p_size < 35 THEN 'high' ELSE 'probable' END AS confidence,
       CASE WHEN p_size < 10 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS ri_diff
FROM part""",
    "responses": """
SELECT p_partkey AS resp_id,
       concat('{"InformationList":{"Information":[{"Synonym":["', p_name, '", " ', CAST(100 + p_partkey % 900 AS STRING), '-0',
              CAST(p_size % 10 AS STRING), CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('-', CAST(p_size % 7 AS STRING)) END, '","77-77-7"]}]}}') AS body,
       concat('{"PropertyTable":{"Properties":[{"CID":1,"InChIKey":"', CASE WHEN p_size % 4 = 0 THEN '' ELSE upper(replace(p_name, ' ', '-')) END, '"}]}}') AS props
FROM part""",
}


def _check_source(name: str) -> str:
    if name in _EXTRA:
        return _EXTRA[name].strip()
    return v.check_view(name)


def extra(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return v._tables(spark, sf_dir, _EXTRA[name])


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns, so that the order of a sum does not show."""
    return df.select(*[
        F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def integers(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---------------------------------------------------------------- two-group comparison

def _student_tail(source: str) -> str:
    """Two-sided p of (compound, t, df) rows by Simpson's rule on the angle form of the t density."""
    return f"""(SELECT compound,
  2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * max((pi() / 2 - atan(abs(t) / sqrt(df))) / 20000) / 3 *
  sum((CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) *
      pow(greatest(0, cos(atan(abs(t) / sqrt(df)) + i * (pi() / 2 - atan(abs(t) / sqrt(df))) / 20000)), df - 1)) AS p
  FROM {source}, generate_series(0, 20000) g(i) GROUP BY compound, t, df)"""


_MOMENTS = """WITH m AS (
  SELECT compound, count(*) FILTER (WHERE grp = 'G0') AS n_a, count(*) FILTER (WHERE grp = 'G1') AS n_b,
         avg(conc) FILTER (WHERE grp = 'G0') AS mean_a, avg(conc) FILTER (WHERE grp = 'G1') AS mean_b,
         var_samp(conc) FILTER (WHERE grp = 'G0') AS var_a, var_samp(conc) FILTER (WHERE grp = 'G1') AS var_b
  FROM peaks WHERE grp IN ('G0', 'G1') AND conc IS NOT NULL GROUP BY compound
  HAVING count(*) FILTER (WHERE grp = 'G0') >= 2 AND count(*) FILTER (WHERE grp = 'G1') >= 2)"""

_WELCH = _MOMENTS + f""", w AS (
  SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
         (var_a / n_a + var_b / n_b) ** 2 / ((var_a / n_a) ** 2 / (n_a - 1) + (var_b / n_b) ** 2 / (n_b - 1)) AS df,
         sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) AS pooled FROM m),
p AS {_student_tail('w')},
r AS (SELECT w.*, p.p, row_number() OVER (ORDER BY p.p, w.compound) AS k, count(*) OVER () AS n FROM w JOIN p USING (compound)),
q AS (SELECT *, least(1.0, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM r),
c AS (SELECT compound, n_a, n_b, mean_a, mean_b, mean_a / mean_b AS fold_change, log2(mean_a / mean_b) AS log2_fc,
       (mean_a - mean_b) / pooled AS cohens_d,
       CASE WHEN abs((mean_a - mean_b) / pooled) > 0.8 THEN 'large' WHEN abs((mean_a - mean_b) / pooled) > 0.5 THEN 'medium' ELSE 'small' END AS effect_size,
       t AS t_statistic, p AS p_value_t, fdr AS p_value_fdr,
       CASE WHEN fdr < 0.001 THEN '***' WHEN fdr < 0.01 THEN '**' WHEN fdr < 0.05 THEN '*' ELSE 'ns' END AS significant FROM q)"""


def _comparison(spark, sf_dir, rank_test=False):
    return compare.compare_groups(v.peaks(spark, sf_dir), "G0", "G1", rank_test=rank_test)


# Mann-Whitney: ranks with ties; the exact tail counts orders of m and n values one value at a time, the normal one is a
# power series of erf.
_RANKS = """
rk AS (SELECT compound, grp, conc, rank() OVER (PARTITION BY compound ORDER BY conc) + (count(*) OVER (PARTITION BY compound, conc) - 1) / 2.0 AS r
       FROM peaks WHERE grp IN ('G0', 'G1') AND conc IS NOT NULL),
tt AS (SELECT compound, sum(t * t * t - t) AS tie FROM (SELECT compound, conc, CAST(count(*) AS DOUBLE) AS t FROM rk GROUP BY 1, 2) x GROUP BY 1),
us AS (SELECT compound, count(*) FILTER (WHERE grp = 'G0') AS a, count(*) FILTER (WHERE grp = 'G1') AS b, sum(r) FILTER (WHERE grp = 'G0') AS s FROM rk GROUP BY 1),
uv AS (SELECT compound, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, s - a * (a + 1) / 2.0 AS u, tie FROM us JOIN tt USING (compound) WHERE a >= 2 AND b >= 2),
ut AS (SELECT *, greatest(u, a * b - u) AS top, tie = 0 AND least(a, b) <= 8 AND a * b <= 4000000 AS exact FROM uv),
lim AS (SELECT coalesce(max(least(a, b)), 0) AS most_m, coalesce(max(greatest(a, b)), 0) AS most_n FROM ut WHERE exact),
seq AS (SELECT 0 AS level, 0 AS m, 0 AS n, 0 AS u, CAST(1 AS DOUBLE) AS c UNION ALL
        SELECT level + 1, m, n, u, sum(c) FROM (
          SELECT level, m + 1 AS m, n, u + n AS u, c FROM seq, lim WHERE m < most_m
          UNION ALL SELECT level, m, n + 1, u, c FROM seq, lim WHERE n < most_n) x GROUP BY ALL),
ex AS (SELECT compound, least(1.0, 2 * sum(c) FILTER (WHERE seq.u >= top) / sum(c)) AS p FROM ut JOIN seq ON exact AND seq.m = least(a, b) AND seq.n = greatest(a, b) GROUP BY compound),
nz AS (SELECT compound, (top - a * b / 2 - 0.5) / sqrt(a * b / 12 * ((a + b + 1) - tie / ((a + b) * (a + b - 1)))) / sqrt(2) AS z FROM ut
       WHERE NOT exact AND (a + b + 1) - tie / ((a + b) * (a + b - 1)) > 0),
no AS (SELECT compound, CASE WHEN z > 5 THEN 0.0 WHEN z <= 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(120),
         lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(z) - lgamma(i + 1)) / (2 * i + 1))) END AS p FROM nz),
mw AS (SELECT compound, p FROM ex UNION ALL SELECT compound, p FROM no)"""


@query("compare_groups", "WITH RECURSIVE " + _WELCH.removeprefix("WITH ") + "," + _RANKS + """
SELECT c.compound, n_a, n_b, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, round(fold_change, 6) AS fold_change,
       round(log2_fc, 6) AS log2_fc, round(cohens_d, 6) AS cohens_d, effect_size, round(t_statistic, 6) AS t_statistic,
       round(p_value_t, 6) AS p_value_t, round(p_value_fdr, 6) AS p_value_fdr, significant, round(mw.p, 6) AS p_value_mwu FROM c LEFT JOIN mw ON mw.compound = c.compound""")
def _compare_groups(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir, rank_test=True), 6, mean_a=8, mean_b=8)


@query("compare_groups_welch", _WELCH + """
SELECT compound, n_a, n_b, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, round(fold_change, 6) AS fold_change,
       round(log2_fc, 6) AS log2_fc, round(cohens_d, 6) AS cohens_d, effect_size, round(t_statistic, 6) AS t_statistic,
       round(p_value_t, 6) AS p_value_t, round(p_value_fdr, 6) AS p_value_fdr, significant FROM c""")
def _compare_groups_welch(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir), 6, mean_a=8, mean_b=8)


@query("comparison_summary", _WELCH + """
SELECT count(*) AS compared, count(*) FILTER (WHERE p_value_t < 0.05) AS significant_raw,
       count(*) FILTER (WHERE significant <> 'ns') AS significant_fdr FROM c""")
def _comparison_summary(spark, sf_dir):
    return compare.comparison_summary(_comparison(spark, sf_dir))


@query("top_significant", _WELCH + """
SELECT compound, round(p_value_t, 6) AS p_value_t, significant FROM c WHERE significant <> 'ns'
ORDER BY c.p_value_t, compound LIMIT 10""")
def _top_significant(spark, sf_dir):
    return rounded(compare.top_significant(_comparison(spark, sf_dir)).select("compound", "p_value_t", "significant"))


@query("volcano", _WELCH + """
SELECT compound, round(log2_fc, 6) AS log2_fc, round(-log10(greatest(p_value_t, 1e-300)), 4) AS neg_log10_p, round(p_value_t, 6) AS p_value_t,
       CASE WHEN -log10(greatest(p_value_t, 1e-300)) > -log10(0.05) AND log2_fc > log2(1.1) THEN 'up'
            WHEN -log10(greatest(p_value_t, 1e-300)) > -log10(0.05) AND log2_fc < -log2(1.1) THEN 'down' ELSE 'ns' END AS direction FROM c""")
def _volcano(spark, sf_dir):
    # groups differ by 10 percent in the test data
    return rounded(compare.volcano(_comparison(spark, sf_dir), 0.05, 1.1), 6, neg_log10_p=4)


@query("volcano_labels", _WELCH + """
, d AS (SELECT compound, -log10(greatest(p_value_t, 1e-300)) AS h, CASE WHEN -log10(greatest(p_value_t, 1e-300)) > -log10(0.05) AND log2_fc > log2(1.1) THEN 'up'
            WHEN -log10(greatest(p_value_t, 1e-300)) > -log10(0.05) AND log2_fc < -log2(1.1) THEN 'down' ELSE 'ns' END AS direction FROM c)
SELECT compound, direction, rank FROM (SELECT compound, direction, CAST(row_number() OVER (PARTITION BY direction ORDER BY h DESC, compound) AS INT) AS rank
  FROM d WHERE direction <> 'ns') x WHERE rank <= 5""")
def _volcano_labels(spark, sf_dir):
    return compare.volcano_labels(compare.volcano(_comparison(spark, sf_dir), 0.05, 1.1)).select("compound", "direction", "rank")


@query("student_t", _MOMENTS + f""", s AS (
  SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)) AS t,
         CAST(n_a + n_b - 2 AS DOUBLE) AS df FROM m), p AS {_student_tail('s')}
SELECT compound, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, round(t, 6) AS t_statistic, df, round(p, 6) AS p_value,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significant
FROM s JOIN p USING (compound)""")
def _student(spark, sf_dir):
    return rounded(compare.student_test(v.peaks(spark, sf_dir), "G0", "G1"), 6, mean_a=8, mean_b=8)


@query("rank_sums", """
WITH x AS (SELECT compound, conc, grp, rank() OVER (PARTITION BY compound ORDER BY conc) AS lo,
                  count(*) OVER (PARTITION BY compound, conc) AS ties FROM peaks WHERE grp IN ('G0', 'G1')),
s AS (SELECT compound, sum(lo + (ties - 1) / 2.0) FILTER (WHERE grp = 'G0') AS r, count(*) FILTER (WHERE grp = 'G0') AS n_a,
             count(*) FILTER (WHERE grp = 'G1') AS n_b, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie_term FROM x GROUP BY compound)
SELECT compound, r - n_a * (n_a + 1) / 2.0 AS u, tie_term, n_a, n_b FROM s WHERE n_a >= 2 AND n_b >= 2""")
def _rank_sums(spark, sf_dir):
    return compare.rank_sums(v.peaks(spark, sf_dir), "G0", "G1")


@query("mann_whitney", "WITH RECURSIVE " + _RANKS.strip() + """
SELECT uv.compound, u, tie AS tie_term, CAST(a AS BIGINT) AS n_a, CAST(b AS BIGINT) AS n_b, round(p, 6) AS p_value FROM uv LEFT JOIN mw USING (compound)""")
def _mann_whitney(spark, sf_dir):
    return rounded(compare.mann_whitney(v.peaks(spark, sf_dir), "G0", "G1"))


@query("result_diff", """
WITH a AS (SELECT compound, avg(conc) AS x FROM peaks WHERE grp = 'G0' GROUP BY compound),
b AS (SELECT compound, avg(conc) AS y FROM peaks WHERE grp = 'G1' GROUP BY compound)
SELECT compound, round(x, 8) AS mean_new, round(y, 8) AS mean_old, round(abs(x - y) / abs(y) * 100, 6) AS diff_pct,
       CASE WHEN abs(x - y) / abs(y) * 100 < 0.1 THEN 'OK' WHEN abs(x - y) / abs(y) * 100 < 1 THEN 'WARN' ELSE 'FAIL' END AS verdict
FROM a JOIN b USING (compound)""")
def _result_diff(spark, sf_dir):
    p = v.peaks(spark, sf_dir)
    return rounded(compare.result_diff(p.filter("grp = 'G0'"), p.filter("grp = 'G1'")), 6, mean_new=8, mean_old=8)


# ---------------------------------------------------------------- descriptive statistics

@query("group_stats", """
SELECT grp, compound, round(avg(conc), 8) AS mean, round(stddev_samp(conc), 8) AS std, min(conc) AS min, max(conc) AS max,
       count(*) AS n, round(stddev_samp(conc) / avg(conc) * 100, 6) AS cv_pct FROM peaks GROUP BY grp, compound""")
def _group_stats(spark, sf_dir):
    return rounded(stats.group_stats(v.peaks(spark, sf_dir)), 8, cv_pct=6)


@query("bar_table", """
SELECT compound, grp, round(avg(conc), 8) AS mean, round(stddev_samp(conc), 8) AS std, count(*) AS n FROM peaks GROUP BY grp, compound""")
def _bar_table(spark, sf_dir):
    return rounded(stats.bar_table(v.peaks(spark, sf_dir)), 8)


@query("descriptive", """
SELECT compound, count(*) AS n, round(avg(conc), 8) AS mean, round(stddev_samp(conc), 8) AS std, min(conc) AS min, max(conc) AS max,
       round(stddev_samp(conc) / avg(conc) * 100, 6) AS cv_pct, round(quantile_cont(conc, 0.25), 8) AS q25,
       round(quantile_cont(conc, 0.5), 8) AS median, round(quantile_cont(conc, 0.75), 8) AS q75 FROM peaks GROUP BY compound""")
def _descriptive(spark, sf_dir):
    return rounded(stats.descriptive(v.peaks(spark, sf_dir)), 8, cv_pct=6)


_BRANDS = [f"brand#{i}" for i in range(1, 26)]


@query("pivot_mean", "SELECT grp, sample, " + ", ".join(
    f"round(avg(conc) FILTER (WHERE compound = '{b}'), 8) AS \"{b}\"" for b in _BRANDS) + " FROM peaks GROUP BY grp, sample")
def _pivot_mean(spark, sf_dir):
    df = stats.pivot_mean(v.peaks(spark, sf_dir), _BRANDS)
    return df.select("grp", "sample", *[F.round(F.col(f"`{b}`"), 8).alias(b) for b in _BRANDS])


@query("composition", """
WITH c AS (SELECT grp, sample, compound, avg(conc) AS conc FROM peaks GROUP BY grp, sample, compound)
SELECT grp, sample, compound, round(conc, 8) AS conc, round(conc / sum(conc) OVER (PARTITION BY grp, sample) * 100, 2) AS pct FROM c""")
def _composition(spark, sf_dir):
    return rounded(stats.composition(v.peaks(spark, sf_dir)), 8, pct=2)


@query("sample_totals", "SELECT grp, sample, round(sum(conc), 6) AS total FROM peaks GROUP BY grp, sample")
def _sample_totals(spark, sf_dir):
    return rounded(stats.sample_totals(v.peaks(spark, sf_dir)))


@query("sample_profile", """
WITH s AS (SELECT * FROM peaks WHERE sample = (SELECT min(sample) FROM peaks WHERE regexp_matches(sample, '(?i)sample0042')))
SELECT grp, sample, compound, round(sum(conc), 6) AS conc, min(rt) AS rt, round(sum(area), 4) AS area,
       round(sum(conc) / (SELECT sum(conc) FROM s) * 100, 2) AS pct_of_total FROM s GROUP BY grp, sample, compound""")
def _sample_profile(spark, sf_dir):
    return rounded(samples.sample_profile(v.peaks(spark, sf_dir), "sample0042"), 6, area=4, rt=12)


@query("overview", """
SELECT count(DISTINCT sample) AS samples, count(*) AS records, count(DISTINCT compound) AS compounds, count(DISTINCT grp) AS groups,
       min(conc) AS conc_min, max(conc) AS conc_max, round(avg(conc), 8) AS conc_mean FROM peaks""")
def _overview(spark, sf_dir):
    return rounded(stats.overview(v.peaks(spark, sf_dir)), 8)


@query("samples_per_group", "SELECT grp, count(DISTINCT sample) AS samples FROM peaks GROUP BY grp")
def _samples_per_group(spark, sf_dir):
    return stats.samples_per_group(v.peaks(spark, sf_dir))


@query("top_compounds", """
WITH t AS (SELECT compound FROM peaks GROUP BY compound ORDER BY avg(conc) DESC, compound LIMIT 8)
SELECT grp, compound, round(avg(conc), 8) AS mean FROM peaks JOIN t USING (compound) GROUP BY grp, compound""")
def _top_compounds(spark, sf_dir):
    return rounded(stats.top_compounds(v.peaks(spark, sf_dir)), 8)


@query("top_per_group", """
WITH m AS (SELECT grp, compound, avg(conc) AS mean FROM peaks GROUP BY grp, compound)
SELECT grp, compound, round(mean, 8) AS mean, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY mean DESC, compound) AS INT) AS rank FROM m) x WHERE rank <= 3""")
def _top_per_group(spark, sf_dir):
    return rounded(stats.top_per_group(v.peaks(spark, sf_dir)), 8)


@query("cv_bands", """
WITH c AS (SELECT compound, stddev_samp(conc) / avg(conc) * 100 AS cv FROM peaks GROUP BY compound HAVING avg(conc) > 0)
SELECT compound, round(cv, 6) AS cv_pct, CASE WHEN cv > 50 THEN 'high' WHEN cv > 25 THEN 'medium' ELSE 'low' END AS band FROM c""")
def _cv_bands(spark, sf_dir):
    return rounded(stats.cv_bands(v.peaks(spark, sf_dir)))


_CV = """WITH cv AS (SELECT round(stddev_samp(conc) / avg(conc) * 100, 1) AS c FROM peaks GROUP BY compound HAVING avg(conc) > 0),
cs AS (SELECT round(avg(c), 1) AS mean_cv, round(median(c), 1) AS median_cv, count(*) FILTER (WHERE c > 50) AS high_cv_count,
       count(*) FILTER (WHERE c < 25) AS low_cv_count FROM cv)"""
_MISSING = """ms AS (SELECT compound, count(DISTINCT sample) AS present FROM peaks GROUP BY compound),
mr AS (SELECT compound, round((1 - present / (SELECT count(DISTINCT sample) FROM peaks)) * 100, 1) AS missing_pct
       FROM ms WHERE present < (SELECT count(DISTINCT sample) FROM peaks))"""
_IQR = """fc AS (SELECT grp, compound, quantile_cont(conc, 0.25) AS q1, quantile_cont(conc, 0.75) AS q3 FROM peaks GROUP BY grp, compound
  HAVING count(*) >= 4),
oc AS (SELECT p.grp, count(*) FILTER (WHERE q3 > q1 AND (conc < q1 - 1.5 * (q3 - q1) OR conc > q3 + 1.5 * (q3 - q1))) AS outliers
       FROM peaks p LEFT JOIN fc ON fc.grp = p.grp AND fc.compound = p.compound GROUP BY p.grp)"""


@query("cv_stats", _CV + " SELECT * FROM cs")
def _cv_stats(spark, sf_dir):
    return stats.cv_stats(v.peaks(spark, sf_dir))


@query("missing_rate", "WITH " + _MISSING + " SELECT * FROM mr")
def _missing_rate(spark, sf_dir):
    return stats.missing_rate(v.peaks(spark, sf_dir))


@query("iqr_outliers", "WITH " + _IQR + " SELECT * FROM oc")
def _iqr_outliers(spark, sf_dir):
    return stats.iqr_outliers(v.peaks(spark, sf_dir))


@query("quality_score", _CV + ", " + _MISSING + ", " + _IQR + """, t AS (
SELECT cs.*, (SELECT count(*) FROM mr) AS n_missing, (SELECT CAST(sum(outliers) AS BIGINT) FROM oc) AS n_outliers,
       (SELECT count(DISTINCT compound) FROM peaks) AS n_compounds FROM cs)
SELECT *, n_missing * 2 + high_cv_count * 1.5::DOUBLE + n_outliers * 0.5::DOUBLE AS total_issues,
       CASE WHEN n_missing * 2 + high_cv_count * 1.5 + n_outliers * 0.5 < n_compounds * 0.5 THEN 'good'
            WHEN n_missing * 2 + high_cv_count * 1.5 + n_outliers * 0.5 < n_compounds * 1.5 THEN 'fair' ELSE 'poor' END AS overall_score,
       concat_ws('; ', CASE WHEN n_missing > 0 THEN concat(n_missing, ' compounds have missing values') END,
         CASE WHEN high_cv_count > 0 THEN concat(high_cv_count, ' compounds have CV% > 50') END,
         CASE WHEN n_outliers > 0 THEN concat(n_outliers, ' IQR outliers') END) AS warnings FROM t""")
def _quality(spark, sf_dir):
    return stats.quality_score(v.peaks(spark, sf_dir))


@query("histogram", """
WITH r AS (SELECT grp, min(conc) AS lo, max(conc) AS hi FROM peaks GROUP BY grp)
SELECT p.grp, CAST(least(29, floor((conc - lo) / (hi - lo) * 30)) AS INT) AS bin, count(*) AS n FROM peaks p JOIN r ON r.grp = p.grp GROUP BY ALL""")
def _histogram(spark, sf_dir):
    return stats.histogram(v.peaks(spark, sf_dir))


_BOX = """WITH f AS (SELECT grp, compound, quantile_cont(conc, 0.25) AS q25, quantile_cont(conc, 0.5) AS median, quantile_cont(conc, 0.75) AS q75
  FROM peaks GROUP BY grp, compound),
j AS (SELECT p.grp, p.compound, conc, q25, median, q75, conc BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS ok
  FROM peaks p JOIN f ON f.grp = p.grp AND f.compound = p.compound)"""


@query("boxplot", _BOX + """
SELECT grp, compound, round(any_value(q25), 8) AS q25, round(any_value(median), 8) AS median, round(any_value(q75), 8) AS q75,
       min(conc) FILTER (WHERE ok) AS whisker_lo, max(conc) FILTER (WHERE ok) AS whisker_hi,
       count(*) FILTER (WHERE NOT ok) AS n_outliers FROM j GROUP BY grp, compound""")
def _boxplot(spark, sf_dir):
    return rounded(stats.boxplot(v.peaks(spark, sf_dir)), 8)


@query("boxplot_outliers", _BOX + " SELECT grp, compound, conc FROM j WHERE NOT ok")
def _boxplot_outliers(spark, sf_dir):
    return stats.boxplot_outliers(v.peaks(spark, sf_dir))


_CELLS = "WITH c AS (SELECT grp, sample, compound, avg(conc) AS conc FROM peaks GROUP BY grp, sample, compound)"
_Z = _CELLS + """, z AS (SELECT grp, sample, compound, conc, (conc - avg(conc) OVER w) / nullif(stddev_samp(conc) OVER w, 0) AS z
  FROM c WINDOW w AS (PARTITION BY compound))"""


@query("zscores", _Z + " SELECT grp, sample, compound, round(z, 6) AS z FROM z")
def _zscores(spark, sf_dir):
    return rounded(stats.zscores(v.peaks(spark, sf_dir)))


@query("zscore_matrix", _Z + " SELECT grp, sample, " + ", ".join(
    f"coalesce(round(max(z) FILTER (WHERE compound = '{b}'), 6), 0.0) AS \"{b}\"" for b in _BRANDS) + " FROM z GROUP BY grp, sample")
def _zscore_matrix(spark, sf_dir):
    df = stats.zscore_matrix(v.peaks(spark, sf_dir), _BRANDS)
    return df.select("grp", "sample", *[F.round(F.col(f"`{b}`"), 6).alias(b) for b in _BRANDS])


@query("anomalies", _Z + " SELECT sample, compound, round(conc, 8) AS value, round(z, 6) AS z_score FROM z WHERE abs(z) > 2.5")
def _anomalies(spark, sf_dir):
    return rounded(stats.anomalies(v.peaks(spark, sf_dir)), 6, value=8)


@query("key_findings", """
WITH m AS (SELECT compound, avg(conc) AS mean, coalesce(stddev_samp(conc) / avg(conc) * 100, 0) AS cv FROM peaks GROUP BY compound)
SELECT * FROM (SELECT 'most_abundant' AS finding, compound, round(mean, 6) AS value FROM m ORDER BY mean DESC, compound LIMIT 5) a
UNION ALL SELECT * FROM (SELECT 'most_variable' AS finding, compound, round(cv, 6) AS value FROM m ORDER BY cv DESC, compound LIMIT 3) b""")
def _key_findings(spark, sf_dir):
    return rounded(stats.key_findings(v.peaks(spark, sf_dir)))


@query("correlation_pearson", """
WITH c AS (SELECT sample, compound, avg(conc) AS x FROM peaks GROUP BY sample, compound)
SELECT a.compound AS a, b.compound AS b, count(*) AS n, round(CASE WHEN isfinite(corr(a.x, b.x)) THEN corr(a.x, b.x) END, 6) AS r
FROM c a JOIN c b ON a.sample = b.sample AND a.compound < b.compound GROUP BY ALL""")
def _pearson(spark, sf_dir):
    return rounded(correlation.pearson(v.peaks(spark, sf_dir)))


@query("correlation_spearman", """
WITH c AS (SELECT sample, compound, avg(conc) AS x FROM peaks GROUP BY sample, compound),
p AS (SELECT a.compound AS a, b.compound AS b, a.x AS xa, b.x AS xb FROM c a JOIN c b ON a.sample = b.sample AND a.compound < b.compound),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xa) + (count(*) OVER (PARTITION BY a, b, xa) - 1) / 2.0 AS ra,
             rank() OVER (PARTITION BY a, b ORDER BY xb) + (count(*) OVER (PARTITION BY a, b, xb) - 1) / 2.0 AS rb FROM p)
SELECT a, b, count(*) AS n, round(CASE WHEN isfinite(corr(ra, rb)) THEN corr(ra, rb) END, 6) AS r FROM r GROUP BY a, b""")
def _spearman(spark, sf_dir):
    return rounded(correlation.spearman(v.peaks(spark, sf_dir)))


@query("strong_correlations", """
WITH c AS (SELECT sample, compound, avg(conc) AS x FROM peaks GROUP BY sample, compound),
k AS (SELECT a.compound AS a, b.compound AS b, corr(a.x, b.x) AS r FROM c a JOIN c b ON a.sample = b.sample AND a.compound < b.compound GROUP BY ALL)
SELECT a, b, round(r, 3) AS r FROM k WHERE isfinite(r) AND abs(r) > 0.5""")
def _strong(spark, sf_dir):
    return correlation.strong_pairs(correlation.pearson(v.peaks(spark, sf_dir)))


def _component(i: int, matrix: str) -> str:
    """The leading eigenvector of a symmetric matrix (a list of rows) by squaring, its largest value positive, and the matrix
    without it."""
    return f"""
p{i} AS (SELECT 0 AS step, rows AS b FROM {matrix} UNION ALL
  SELECT step + 1, list_transform(b, lambda r: list_transform(b, lambda c: list_dot_product(r, c) / t))
  FROM (SELECT *, list_sum(list_transform(b, lambda d: list_dot_product(d, d))) AS t FROM p{i} WHERE step < 18) x),
r{i} AS (SELECT arg_max(r, list_dot_product(r, r)) AS r FROM (SELECT unnest(b) AS r FROM p{i} WHERE step = 18) x),
u{i} AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS r FROM r{i}),
w{i} AS (SELECT list_transform(rows, lambda c: list_dot_product(c, r)) AS r FROM u{i}, {matrix}),
a{i} AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS r FROM w{i}),
v{i} AS (SELECT CASE WHEN list_max(r) >= -list_min(r) THEN r ELSE list_transform(r, lambda x: -x) END AS r FROM a{i}),
e{i} AS (SELECT list_dot_product(r, list_transform(rows, lambda c: list_dot_product(c, r))) AS x FROM v{i}, {matrix}),
m{i} AS (SELECT list_transform(rows, lambda c, k: list_transform(c, lambda y, l: y - x * r[k] * r[l])) AS rows FROM v{i}, e{i}, {matrix})"""


# The table is standardised as a whole, its covariance formed, and one component after the other taken off it.
_PCA = """WITH RECURSIVE c AS (SELECT grp, sample, compound, avg(conc) AS x FROM peaks WHERE compound IS NOT NULL GROUP BY ALL),
rw AS (SELECT DISTINCT grp, sample FROM c),
cn AS (SELECT compound, row_number() OVER (ORDER BY compound) AS j FROM (SELECT DISTINCT compound FROM c) x),
f AS (SELECT rw.grp, rw.sample, cn.compound, cn.j, coalesce(c.x, 0) AS x FROM rw CROSS JOIN cn LEFT JOIN c ON c.grp = rw.grp AND c.sample = rw.sample AND c.compound = cn.compound),
z AS (SELECT grp, sample, compound, j, coalesce((x - avg(x) OVER k) / nullif(stddev_pop(x) OVER k, 0), 0) AS z FROM f WINDOW k AS (PARTITION BY j)),
cv AS (SELECT a.j AS ja, b.j AS jb, sum(a.z * b.z) / (SELECT count(*) FROM rw) AS x FROM z a JOIN z b ON a.grp = b.grp AND a.sample = b.sample GROUP BY 1, 2),
m0 AS (SELECT list(r ORDER BY ja) AS rows FROM (SELECT ja, list(x ORDER BY jb) AS r FROM cv GROUP BY ja) y),""" + ",".join(
    _component(i, f"m{i - 1}") for i in (1, 2, 3)
) + """,
ld AS (SELECT compound, j, v1.r[j] AS pc1, v2.r[j] AS pc2, v3.r[j] AS pc3 FROM cn, v1, v2, v3),
sc AS (SELECT grp, sample, sum(z * pc1) AS pc1, sum(z * pc2) AS pc2, sum(z * pc3) AS pc3 FROM z JOIN ld USING (j) GROUP BY grp, sample)"""


@query("pca_scores", _PCA + " SELECT grp, sample, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2, round(pc3, 6) AS pc3 FROM sc")
def _pca(spark, sf_dir):
    return rounded(correlation.principal_components(v.peaks(spark, sf_dir))[0])


@query("pca_loadings", _PCA + " SELECT compound, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2, round(pc3, 6) AS pc3 FROM ld")
def _pca_loadings(spark, sf_dir):
    return rounded(correlation.principal_components(v.peaks(spark, sf_dir))[1])


@query("pca_ellipses", _PCA + """,
g AS (SELECT grp, count(*) AS n, avg(pc1) AS cx, avg(pc2) AS cy, var_samp(pc1) AS a, var_samp(pc2) AS b, covar_samp(pc1, pc2) AS c FROM sc GROUP BY grp HAVING count(*) >= 3)
SELECT grp, n, round(cx, 5) AS centre_x, round(cy, 5) AS centre_y, round(2 * sqrt(5.991 * ((a + b) / 2 - sqrt((a - b) ** 2 / 4 + c * c))), 5) AS width,
       round(2 * sqrt(5.991 * ((a + b) / 2 + sqrt((a - b) ** 2 / 4 + c * c))), 5) AS height, round(degrees(atan2(2 * c, a - b)) / 2 + 90, 5) AS angle FROM g""")
def _pca_ellipses(spark, sf_dir):
    return rounded(correlation.confidence_ellipses(correlation.principal_components(v.peaks(spark, sf_dir))[0]), 5)


# ---------------------------------------------------------------- filters and samples

_COUNTED = "grp, count(*) AS n, round(sum(area), 2) AS area"


def _counted(df: DataFrame) -> DataFrame:
    return rounded(df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area")), 2)


_FILTERS = {
    "filter_min_area": (lambda p: filters.min_area(p, 30000), "area >= 30000"),
    "filter_min_match": (lambda p: filters.min_match(p, 70), "match_factor IS NULL OR match_factor >= 70"),
    "filter_identified": (filters.identified, "compound IS NOT NULL AND compound NOT LIKE 'RT\\_%' ESCAPE '\\' AND compound NOT LIKE 'rt\\_%' ESCAPE '\\'"),
    "filter_contaminants": (lambda p: filters.without_contaminants(p, ["brand#1", "rt_"]), "NOT (contains(lower(compound), 'brand#1') OR contains(lower(compound), 'rt_'))"),
    "filter_include": (lambda p: filters.include_compounds(p, "Brand#2, rt_1"), "contains(lower(compound), 'brand#2') OR contains(lower(compound), 'rt_1')"),
    "filter_exclude": (lambda p: filters.exclude_compounds(p, "Brand#2, rt_1"), "NOT (contains(lower(compound), 'brand#2') OR contains(lower(compound), 'rt_1'))"),
    "filter_default": (filters.default_filter, "area >= 10000 AND (match_factor IS NULL OR match_factor >= 70)"),
    "restrict_samples": (lambda p: filters.restrict_samples(p, "004, Sample0012"), "contains(sample, '004') OR contains(sample, 'Sample0012')"),
    "needs_identification": (
        lambda p: p.withColumn("match_method", F.when(F.col("conc") > 4, "builtin_library")).filter(filters.needs_id()),
        "lower(compound) LIKE 'rt\\_%' ESCAPE '\\' OR conc > 4",
    ),
}
for _name, (_apply, _where) in _FILTERS.items():
    query(_name, f"SELECT {_COUNTED} FROM peaks WHERE {_where} GROUP BY grp")(
        lambda spark, sf_dir, apply=_apply: _counted(apply(v.peaks(spark, sf_dir)))
    )


@query("filter_default_counts", """
SELECT count(*) AS rows_before, count(*) FILTER (WHERE area < 10000) AS area_filtered,
       count(*) FILTER (WHERE area >= 10000 AND match_factor < 70) AS match_filtered,
       count(*) FILTER (WHERE area >= 10000 AND (match_factor IS NULL OR match_factor >= 70)) AS rows_after FROM peaks""")
def _default_counts(spark, sf_dir):
    return filters.default_filter_counts(v.peaks(spark, sf_dir))


@query("filter_summary", """
WITH k AS (SELECT * FROM peaks WHERE area >= 10000 AND (match_factor IS NULL OR match_factor >= 70))
SELECT 'before' AS side, count(*) AS records, count(DISTINCT compound) AS compounds, count(DISTINCT sample) AS samples FROM peaks
UNION ALL SELECT 'after', count(*), count(DISTINCT compound), count(DISTINCT sample) FROM k""")
def _filter_summary(spark, sf_dir):
    p = v.peaks(spark, sf_dir)
    return filters.filter_summary(p, filters.default_filter(p))


@query("top_by_area", """
SELECT compound, round(avg(area), 4) AS mean_area FROM peaks GROUP BY compound ORDER BY avg(area) DESC, compound LIMIT 10""")
def _top_by_area(spark, sf_dir):
    return rounded(filters.top_by_area(v.peaks(spark, sf_dir)), 4)


@query("set_groups_exact", """
SELECT CASE WHEN sample IN ('Sample0012.D', 'Sample0033.D') THEN 'Control' ELSE grp END AS grp, count(*) AS n, count(DISTINCT sample) AS samples
FROM peaks GROUP BY 1""")
def _set_groups(spark, sf_dir):
    df = samples.set_groups(v.peaks(spark, sf_dir), "Control", "Sample0012, Sample0033.D, Sample9999999")
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample").alias("samples"))


@query("set_groups_fuzzy", """
SELECT CASE WHEN contains(sample, 'Sample001') OR contains(sample, 'Sample002') OR contains(sample, '0044')
            THEN 'Treated' ELSE grp END AS grp, count(*) AS n, count(DISTINCT sample) AS samples
FROM peaks GROUP BY 1""")
def _set_groups_fuzzy(spark, sf_dir):
    # no three-digit name exists, so containment decides
    df = samples.set_groups(v.peaks(spark, sf_dir), "Treated", "1-2, 0044")
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample").alias("samples"))


@query("sample_columns", """
SELECT DISTINCT sample, grp AS sub_group, CAST(regexp_extract(sample, '([0-9]+)[.]D', 1) AS INT) AS sample_num,
       replace(sample, '.D', '') AS label FROM peaks""")
def _sample_columns(spark, sf_dir):
    return samples.with_sample_columns(v.peaks(spark, sf_dir)).select("sample", "sub_group", "sample_num", "label").distinct()


# ---------------------------------------------------------------- retention time

@query("align_rt", """
WITH d AS (SELECT rt, count(*) AS n FROM peaks GROUP BY rt),
g AS (SELECT rt, n, CASE WHEN rt - lag(rt) OVER (ORDER BY rt) <= CAST(0.0021 AS DOUBLE) THEN 0 ELSE 1 END AS s FROM d),
i AS (SELECT rt, n, sum(s) OVER (ORDER BY rt) AS cluster_id FROM g),
c AS (SELECT cluster_id, round(sum(rt * n) / sum(n), 4) AS consensus_rt, count(*) AS times, CAST(sum(n) AS BIGINT) AS members,
             min(rt) AS rt_lo, max(rt) AS rt_hi FROM i GROUP BY cluster_id)
SELECT CAST(cluster_id AS BIGINT) AS cluster_id, consensus_rt, times, members, rt_lo, rt_hi,
       concat('RT_', CAST((CAST(round(consensus_rt * 10000) AS BIGINT) + 5) // 10000 AS VARCHAR), '.',
              lpad(CAST(((CAST(round(consensus_rt * 10000) AS BIGINT) + 5) // 10) % 1000 AS VARCHAR), 3, '0')) AS compound FROM c""")
def _align(spark, sf_dir):
    a = chrom.align_by_rt(v.peaks(spark, sf_dir), 0.0021)
    return a.groupBy("cluster_id", "consensus_rt", "compound").agg(
        F.countDistinct("rt").alias("times"), F.count(F.lit(1)).alias("members"), F.min("rt").alias("rt_lo"), F.max("rt").alias("rt_hi")
    )


_RT_MATCH = """WITH t AS (SELECT DISTINCT rt FROM peaks WHERE lower(compound) LIKE 'rt\\_%' ESCAPE '\\'),
h AS (SELECT rt, name, cat, rt_est, row_number() OVER (PARTITION BY rt ORDER BY abs(rt - rt_est), ord) AS k
      FROM t JOIN rt_library ON abs(rt - rt_est) <= CAST(0.3 AS DOUBLE)),
j AS (SELECT p.*, h.name, h.cat, h.rt_est FROM peaks p LEFT JOIN h ON h.rt = p.rt AND h.k = 1 AND lower(p.compound) LIKE 'rt\\_%' ESCAPE '\\')"""


@query("match_rt_library", _RT_MATCH + """
SELECT coalesce(name, compound) AS compound, cat AS category, CASE WHEN name IS NOT NULL THEN 'builtin_library' END AS match_method,
       count(*) AS n, round(max(abs(rt - rt_est)), 6) AS max_diff FROM j GROUP BY ALL""", ("peaks", "rt_library"))
def _match_rt(spark, sf_dir):
    m = rtmatch.match_rt_library(v.peaks(spark, sf_dir), v.rt_library(spark, sf_dir))
    return rounded(m.groupBy("compound", "category", "match_method").agg(F.count(F.lit(1)).alias("n"), F.max("rt_diff").alias("max_diff")))


@query("rt_category_counts", _RT_MATCH + " SELECT cat AS category, count(*) AS n FROM j WHERE name IS NOT NULL GROUP BY cat", ("peaks", "rt_library"))
def _rt_categories(spark, sf_dir):
    return rtmatch.category_counts(rtmatch.match_rt_library(v.peaks(spark, sf_dir), v.rt_library(spark, sf_dir)))


@query("vendor_merge", """
WITH t AS (SELECT DISTINCT sample, rt FROM peaks),
n AS (SELECT h.*, t.rt AS peak_rt, row_number() OVER (PARTITION BY h.sample, file_priority, file, hit_seq ORDER BY abs(t.rt - h.rt), t.rt) AS k
      FROM vendor_hits h JOIN t ON t.sample = h.sample AND abs(t.rt - h.rt) < CAST(0.05 AS DOUBLE)),
f AS (SELECT sample, min(file_priority) AS file_priority FROM n GROUP BY sample),
u AS (SELECT n.* FROM n JOIN f ON f.sample = n.sample AND f.file_priority = n.file_priority WHERE k = 1),
l AS (SELECT sample, peak_rt,
             arg_max(lower(compound), hit_seq) FILTER (WHERE lower(compound) NOT IN ('', 'unknown', 'unknown compound')) AS c,
             arg_max(match_factor, hit_seq) FILTER (WHERE match_factor > 0) AS m, arg_max(reverse_match, hit_seq) FILTER (WHERE reverse_match > 0) AS r,
             arg_max(formula, hit_seq) FILTER (WHERE formula <> '') AS f, arg_max(cas, hit_seq) FILTER (WHERE cas <> '') AS s
      FROM u GROUP BY sample, peak_rt)
SELECT p.sample, coalesce(c, p.compound) AS compound, coalesce(m, p.match_factor) AS match_factor, r AS reverse_match, f AS formula, s AS cas, count(*) AS n
FROM peaks p LEFT JOIN l ON l.sample = p.sample AND l.peak_rt = p.rt GROUP BY ALL""", ("peaks", "vendor_hits"))
def _vendor(spark, sf_dir):
    m = rtmatch.merge_vendor_hits(v.peaks(spark, sf_dir), extra(spark, sf_dir, "vendor_hits"))
    return m.groupBy("sample", "compound", "match_factor", "reverse_match", "formula", "cas").agg(F.count(F.lit(1)).alias("n"))


@query("scans_within", """
WITH t AS (SELECT DISTINCT sample, rt FROM peaks)
SELECT sample, rt, scan_rt FROM (SELECT t.sample, rt, scan_rt, row_number() OVER (PARTITION BY t.sample, rt ORDER BY abs(rt - scan_rt), scan_rt) AS k
  FROM t JOIN scan_times s ON s.sample = t.sample AND abs(rt - scan_rt) <= CAST(0.05 AS DOUBLE)) x WHERE k = 1""", ("peaks", "scan_times"))
def _scans_within(spark, sf_dir):
    return rtmatch.scans_within(v.peaks(spark, sf_dir), extra(spark, sf_dir, "scan_times"))


@query("nearest_scans", """
WITH t AS (SELECT DISTINCT sample, rt FROM peaks)
SELECT sample, rt, scan_rt FROM (SELECT t.sample, rt, scan_rt, row_number() OVER (PARTITION BY t.sample, rt ORDER BY abs(rt - scan_rt), scan_rt) AS k
  FROM t JOIN scan_times s ON s.sample = t.sample) x WHERE k = 1""", ("peaks", "scan_times"))
def _nearest_scans(spark, sf_dir):
    return rtmatch.nearest_scans(v.peaks(spark, sf_dir), extra(spark, sf_dir, "scan_times"))


@query("spread_identifications", """
WITH t AS (SELECT DISTINCT rt FROM peaks),
c AS (SELECT t.rt, a.name, a.combined_score, a.confidence, a.ri_diff, row_number() OVER (PARTITION BY t.rt ORDER BY target_seq DESC) AS k
      FROM t JOIN accepted_ids a ON abs(t.rt - a.rt) < CAST(0.01 AS DOUBLE) WHERE confidence IN ('confirmed', 'high'))
SELECT coalesce(name, compound) AS compound, coalesce(combined_score, match_factor) AS match_factor,
       CASE WHEN name IS NOT NULL THEN concat('ms_ri_dual_', confidence) END AS match_method,
       CASE WHEN ri_diff IS NOT NULL THEN true END AS ri_confirmed, count(*) AS n
FROM peaks p LEFT JOIN c ON c.rt = p.rt AND k = 1 GROUP BY ALL""", ("peaks", "accepted_ids"))
def _spread(spark, sf_dir):
    m = rtmatch.spread_identifications(v.peaks(spark, sf_dir), extra(spark, sf_dir, "accepted_ids"))
    return m.groupBy("compound", "match_factor", "match_method", "ri_confirmed").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- chromatograms

_PEAK_ARGS = dict(prominence=0.05, min_width=1, min_height=20000)
_FIND = """WITH a AS (SELECT sample, idx, t, y, lag(y) OVER w AS yp, lead(y) OVER w AS yn FROM tic WINDOW w AS (PARTITION BY sample ORDER BY idx)),
c AS (SELECT sample, idx AS peak_idx, y AS height FROM a WHERE yp < y AND yn < y AND y >= 20000),
b AS (SELECT c.*, (SELECT max(idx) FROM tic x WHERE x.sample = c.sample AND x.idx < peak_idx AND x.y > height) AS hl,
             (SELECT min(idx) FROM tic x WHERE x.sample = c.sample AND x.idx > peak_idx AND x.y > height) AS hr FROM c),
s AS (SELECT b.*, (SELECT min(y) FROM tic x WHERE x.sample = b.sample AND x.idx <= peak_idx AND x.idx > coalesce(hl, -1)) AS lm,
             (SELECT min(y) FROM tic x WHERE x.sample = b.sample AND x.idx >= peak_idx AND x.idx < coalesce(hr, 1000000000)) AS rm FROM b),
p AS (SELECT s.sample, peak_idx, height, height - greatest(lm, rm) AS prominence, height - (height - greatest(lm, rm)) * 0.5::DOUBLE AS width_height
      FROM s JOIN (SELECT sample, max(y) - min(y) AS rng FROM tic GROUP BY sample) r ON r.sample = s.sample
      WHERE height - greatest(lm, rm) >= greatest(0.05::DOUBLE * rng, 2000)),
e AS (SELECT p.*, (SELECT max(idx) FROM tic x WHERE x.sample = p.sample AND x.idx < peak_idx AND x.y <= width_height) AS li,
             (SELECT min(idx) FROM tic x WHERE x.sample = p.sample AND x.idx > peak_idx AND x.y <= width_height) AS ri FROM p),
f AS (SELECT e.sample, peak_idx, height, prominence, width_height,
             li + (width_height - l0.y) / (l1.y - l0.y) AS left_ip, ri - (width_height - r0.y) / (r1.y - r0.y) AS right_ip
      FROM e JOIN tic l0 ON l0.sample = e.sample AND l0.idx = li JOIN tic l1 ON l1.sample = e.sample AND l1.idx = li + 1
             JOIN tic r0 ON r0.sample = e.sample AND r0.idx = ri JOIN tic r1 ON r1.sample = e.sample AND r1.idx = ri - 1),
k AS (SELECT * FROM f WHERE right_ip - left_ip >= 1)"""


@query("find_peaks", _FIND + """
SELECT sample, CAST(peak_idx AS BIGINT) AS peak_idx, round(height, 6) AS height, round(prominence, 6) AS prominence, round(width_height, 6) AS width_height,
       round(left_ip, 6) AS left_ip, round(right_ip, 6) AS right_ip, round(right_ip - left_ip, 6) AS width_50pct FROM k""", ("tic",))
def _find_peaks(spark, sf_dir):
    return rounded(chrom.find_peaks(v.tic(spark, sf_dir), **_PEAK_ARGS))


@query("detect_peaks", _FIND + """,
n AS (SELECT sample, max(idx) AS last FROM tic GROUP BY sample),
w AS (SELECT k.*, row_number() OVER (PARTITION BY k.sample ORDER BY peak_idx) AS peak_id, greatest(0, floor(left_ip) - 5) AS lo, least(last, floor(right_ip) + 5) AS hi
      FROM k JOIN n ON n.sample = k.sample),
x AS (SELECT w.sample, peak_id, idx, t, y, lo, hi, lead(t) OVER (PARTITION BY w.sample, peak_id ORDER BY idx) AS t1, lead(y) OVER (PARTITION BY w.sample, peak_id ORDER BY idx) AS y1,
             min(y) OVER (PARTITION BY w.sample, peak_id) AS base FROM w JOIN tic ON tic.sample = w.sample AND idx BETWEEN lo AND hi),
ar AS (SELECT sample, peak_id, round(sum((t1 - t) * ((y - base) + (y1 - base)) / 2), 1) AS area FROM x GROUP BY sample, peak_id),
q AS (SELECT w.sample, w.peak_id, tp.t AS rt, tl.t AS rt_start, tr.t AS rt_end, round(height, 1) AS height, ar.area, right_ip - left_ip AS width, width_height, prominence
      FROM w JOIN ar ON ar.sample = w.sample AND ar.peak_id = w.peak_id JOIN tic tp ON tp.sample = w.sample AND tp.idx = peak_idx
      JOIN tic tl ON tl.sample = w.sample AND tl.idx = floor(left_ip) JOIN tic tr ON tr.sample = w.sample AND tr.idx = floor(right_ip) WHERE ar.area >= 1000)
SELECT sample, peak_id, round(rt, 4) AS rt, round(rt_start, 4) AS rt_start, round(rt_end, 4) AS rt_end, height, area, round(width, 6) AS width_50pct,
       round(width_height, 6) AS width_height, round(prominence, 1) AS prominence, round(area / sum(area) OVER (PARTITION BY sample) * 100, 2) AS area_pct FROM q""", ("tic",))
def _detect_peaks(spark, sf_dir):
    return rounded(chrom.detect_peaks(v.tic(spark, sf_dir), min_area=1000, **_PEAK_ARGS))


_FIND_GAPS = _FIND.replace("WITH a AS", """WITH tic AS (SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY idx) - 1 AS idx, idx AS x, t, y
   FROM tic_gaps WHERE y IS NOT NULL), a AS""").replace("li + (width", "l0.x + (l1.x - l0.x) * (width").replace("ri - (width", "r0.x + (r1.x - r0.x) * (width")


@query("find_peaks_gaps", _FIND_GAPS + """
SELECT k.sample, CAST(tic.x AS BIGINT) AS peak_idx, round(height, 6) AS height, round(prominence, 6) AS prominence, round(width_height, 6) AS width_height,
       round(left_ip, 6) AS left_ip, round(right_ip, 6) AS right_ip, round(right_ip - left_ip, 6) AS width_50pct
FROM k JOIN tic ON tic.sample = k.sample AND tic.idx = peak_idx""", ("tic_gaps",))
def _find_peaks_gaps(spark, sf_dir):
    return rounded(chrom.find_peaks(v.tic_gaps(spark, sf_dir), **_PEAK_ARGS))


# ---------------------------------------------------------------- spectrum search

_PAIRS = """WITH sq AS (SELECT spec_id, sum(CAST(intensity AS DOUBLE) * intensity) AS sq, count(*) AS n, max(mz) AS top FROM spectra GROUP BY spec_id),
d AS (SELECT q.spec_id AS query_id, l.spec_id AS lib_id, CAST(sum(q.intensity * l.intensity) AS DOUBLE) AS dot, count(*) AS matched
      FROM spectra q JOIN spectra l ON l.mz = q.mz WHERE q.spec_id % 2 = 1 AND l.spec_id % 2 = 0 GROUP BY 1, 2),
s AS (SELECT d.*, a.sq AS qsq, a.n AS qn, a.top AS qtop, b.sq AS lsq, b.n AS ln, b.top AS ltop, r.* EXCLUDE (lib_id),
             CASE WHEN query_id % 3 <> 0 THEN CAST(401 + query_id * 97 % 3500 AS DOUBLE) END AS ri_expected
      FROM d JOIN sq a ON a.spec_id = query_id JOIN sq b ON b.spec_id = d.lib_id JOIN library_rows r ON r.lib_id = d.lib_id),
z AS (SELECT *, trunc(least(999, dot / sqrt(lsq * qsq) * 999)) AS cos,
             trunc(least(999, (dot / sqrt(lsq * qsq) * 0.8::DOUBLE + matched / qn * 0.2::DOUBLE) * 999)) AS fwd,
             trunc(least(999, (dot / sqrt(lsq * lsq) * 0.7::DOUBLE + matched / ln * 0.3::DOUBLE) * 999)) AS rev,
             abs(ri_exp - ri_expected) AS rd FROM s),
y AS (SELECT *, trunc(least(999, (fwd / 999.0::DOUBLE * 0.6::DOUBLE + rev / 999.0::DOUBLE * (1 - 0.6::DOUBLE)) * 999)) AS hyb,
             CASE WHEN rd IS NULL OR rd <= 50 THEN 1.0::DOUBLE WHEN rd <= 100 THEN 1.0::DOUBLE - 0.5::DOUBLE * (rd - 50) / 50
                  WHEN rd <= 200 THEN 0.5::DOUBLE - 0.4::DOUBLE * (rd - 100) / 100 ELSE 0.1::DOUBLE END AS pen,
             CASE compound_class WHEN 'food_flavor' THEN 1.05::DOUBLE + 0.15::DOUBLE * class_confidence WHEN 'natural_product' THEN 1.05::DOUBLE + 0.10::DOUBLE * class_confidence
                  WHEN 'pharmaceutical' THEN 0.85::DOUBLE - 0.15::DOUBLE * least(class_confidence, 1) WHEN 'industrial' THEN 0.75::DOUBLE - 0.10::DOUBLE * least(class_confidence, 1)
                  ELSE 1.0::DOUBLE END AS fac FROM z)"""


def _search_check(score: str, threshold: int, factor: str = "1.0::DOUBLE") -> str:
    return _PAIRS + f""",
h AS (SELECT *, {score} AS mf, trunc({score} * pen * {factor}) AS eff, {factor} AS used FROM y WHERE {score} >= {threshold}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, load_seq) AS place FROM h),
b AS (SELECT *, first_value(mf) OVER (PARTITION BY query_id ORDER BY place) AS mf1, first_value(ri_exp) OVER (PARTITION BY query_id ORDER BY place) AS ri1,
             min(place) FILTER (WHERE ri_exp IS NOT NULL) OVER (PARTITION BY query_id) AS bp FROM o),
m AS (SELECT *, coalesce(place = bp AND ri_expected IS NOT NULL AND ri1 IS NULL AND mf >= mf1 - 80 AND pen >= 0.9, false) AS moved FROM b)
SELECT query_id, lib_id, name, cas, formula, CAST(mf AS INT) AS match_factor, CAST(eff AS INT) AS effective_match, ri_exp AS ri, round(pen, 6) AS ri_penalty,
       round(used, 6) AS category_factor, compound_class, CAST(ln AS INT) AS num_peaks,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY moved DESC, place) AS INT) AS rank FROM m"""


_SPECTRA_VIEWS = ("spectra", "library_rows")


def _search(spark, sf_dir, **kwargs):
    return rounded(spectra.search(v.queries(spark, sf_dir), v.library(spark, sf_dir), **kwargs))


for _mode, _expr, _limit in (("cosine", "cos", 600), ("forward", "fwd", 600), ("reverse", "rev", 600), ("hybrid", "hyb", 600)):
    query(f"spectrum_search_{_mode}", _search_check(_expr, _limit), _SPECTRA_VIEWS)(
        lambda spark, sf_dir, m=_mode, k=_limit: _search(spark, sf_dir, mode=m, min_match=k)
    )
query("spectrum_search_boosted", _search_check("hyb", 650, "fac"), _SPECTRA_VIEWS)(
    lambda spark, sf_dir: _search(spark, sf_dir, min_match=650, category_boost=True)
)


@query("spectrum_best", "SELECT query_id, lib_id, match_factor FROM (" + "".join(
    ["{check}"]) + ") x WHERE rank = 1", ())
def _spectrum_best(spark, sf_dir):
    return spectra.best_hit(_search(spark, sf_dir, k=1)).select("query_id", "lib_id", "match_factor")


CHECKS["spectrum_best"] = CHECKS["spectrum_best"].replace("{check}", CHECKS["spectrum_search_hybrid"])


@query("spectrum_search_fast", _PAIRS + """,
f AS (SELECT *, fwd * 0.6::DOUBLE + rev * 0.4::DOUBLE AS s0 FROM y),
g AS (SELECT *, CASE WHEN rd IS NOT NULL THEN trunc(s0 * pen) ELSE s0 END AS s1 FROM f),
h AS (SELECT *, CASE compound_class WHEN 'food_flavor' THEN trunc(s1 * 1.1::DOUBLE) WHEN 'pharmaceutical' THEN trunc(s1 * 0.8::DOUBLE)
                WHEN 'industrial' THEN trunc(s1 * 0.75::DOUBLE) ELSE s1 END AS s2 FROM g)
SELECT query_id, lib_id, name, cas, formula, CAST(trunc(s2) AS INT) AS match_factor, CAST(trunc(s2) AS INT) AS effective_match, ri_exp AS ri, round(pen, 6) AS ri_penalty,
       1.0::DOUBLE AS category_factor, compound_class, CAST(ln AS INT) AS num_peaks,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, load_seq) AS INT) AS rank FROM h WHERE s2 >= 600""", _SPECTRA_VIEWS)
def _search_fast(spark, sf_dir):
    return _search(spark, sf_dir, profile="fast", category_boost=True)


# Measured m/z: each ion takes the nearest one of the other spectrum, the first of equally near ones.
_NEAREST = """
e AS (SELECT q.spec_id AS query_id, l.spec_id AS lib_id, q.ion_idx AS qi, l.ion_idx AS li, q.intensity AS qx, l.intensity AS lx, abs(q.mz - l.mz) AS gap
      FROM spectra_fine q JOIN spectra_fine l ON q.mz BETWEEN l.mz - 0.6 AND l.mz + 0.6
      WHERE q.spec_id % 2 = 1 AND l.spec_id % 2 = 0 AND abs(q.mz - l.mz) <= 0.5),
dl AS (SELECT query_id, lib_id, CAST(sum(x) AS DOUBLE) AS dot, count(*) AS matched FROM (
         SELECT query_id, lib_id, li, arg_min(qx * lx, [gap, qi]) AS x FROM e GROUP BY ALL) z GROUP BY 1, 2),
dq AS (SELECT query_id, lib_id, CAST(sum(x) AS DOUBLE) AS dot_back, count(*) AS matched_back FROM (
         SELECT query_id, lib_id, qi, arg_min(qx * lx, [gap, li]) AS x FROM e GROUP BY ALL) z GROUP BY 1, 2),
d AS (SELECT * FROM dl JOIN dq USING (query_id, lib_id)),
"""


def _measured(sql: str) -> str:
    """A check over whole m/z made one over measured m/z."""
    head, rest = sql.split("d AS (", 1)
    text = head + _NEAREST.strip("\n") + "\n" + rest[rest.index("s AS (") :]
    return re.sub(r"\bspectra\b", "spectra_fine", text).replace("matched / qn", "matched_back / qn")


_FINE_VIEWS = ("spectra_fine", "library_rows")

for _mode, _expr, _limit in (("cosine", "cos", 700), ("forward", "fwd", 740), ("reverse", "rev", 760), ("hybrid", "hyb", 750)):
    query(f"spectrum_measured_{_mode}", _measured(_search_check(_expr, _limit)), _FINE_VIEWS)(
        lambda spark, sf_dir, m=_mode, k=_limit: rounded(spectra.search(
            v.queries(spark, sf_dir, "spectra_fine"), v.library(spark, sf_dir, "spectra_fine"), mode=m, min_match=k
        ))
    )


_MANAGER = _PAIRS + """,
t5 AS (SELECT spec_id, mz FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, ion_idx) AS k FROM spectra) x WHERE k <= 5),
t1 AS (SELECT spec_id AS lib_id, mz AS bp FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, ion_idx) AS k FROM spectra) x WHERE k = 1),
cand AS (SELECT DISTINCT t5.spec_id AS query_id, t1.lib_id FROM t5 JOIN t1 ON abs(t5.mz - t1.bp) <= 1 WHERE t5.spec_id % 2 = 1 AND t1.lib_id % 2 = 0),
near AS (SELECT y.* FROM y WHERE (y.query_id, y.lib_id) IN (SELECT query_id, lib_id FROM cand) OR y.query_id NOT IN (SELECT query_id FROM cand)),
mg AS (SELECT *, CASE WHEN cos < 400 THEN least(cos, 500) ELSE cos END AS mf FROM near WHERE ln >= 3),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mf DESC, load_seq) AS rank FROM mg WHERE mf >= {limit})"""


@query("spectrum_search_manager", _MANAGER.replace("{limit}", "450") + """
SELECT query_id, lib_id, name, cas, CAST(mf AS INT) AS match_factor, CAST(cos AS INT) AS match_forward, CAST(cos AS INT) AS match_reverse, source,
       CAST(ln AS INT) AS n_ref_peaks, CAST(rank AS INT) AS rank FROM top WHERE rank <= 20""", _SPECTRA_VIEWS)
def _search_manager(spark, sf_dir):
    return spectra.search_manager(v.queries(spark, sf_dir), v.library(spark, sf_dir), min_match=450).select(
        "query_id", "lib_id", "name", "cas", "match_factor", "match_forward", "match_reverse", "source", "n_ref_peaks", "rank"
    )


@query("spectrum_measured_manager", _measured(_PAIRS) + """,
w AS (SELECT *, trunc(least(999, dot_back / sqrt(qsq * lsq) * 999)) AS back FROM y),
t5 AS (SELECT spec_id, CAST(trunc(mz) AS INT) AS mz FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, ion_idx) AS k FROM spectra_fine) x WHERE k <= 5),
t1 AS (SELECT spec_id AS lib_id, CAST(trunc(mz) AS INT) AS bp FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY intensity DESC, ion_idx) AS k FROM spectra_fine) x WHERE k = 1),
cand AS (SELECT DISTINCT t5.spec_id AS query_id, t1.lib_id FROM t5 JOIN t1 ON abs(t5.mz - t1.bp) <= 1 WHERE t5.spec_id % 2 = 1 AND t1.lib_id % 2 = 0),
near AS (SELECT w.* FROM w WHERE (w.query_id, w.lib_id) IN (SELECT query_id, lib_id FROM cand) OR w.query_id NOT IN (SELECT query_id FROM cand)),
mg AS (SELECT *, CASE WHEN cos < 400 OR back < 400 THEN least(floor((cos + back) / 2), 500) ELSE floor((cos + back) / 2) END AS mf FROM near WHERE ln >= 3),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mf DESC, load_seq) AS rank FROM mg WHERE mf >= 600)
SELECT query_id, lib_id, name, CAST(mf AS INT) AS match_factor, CAST(cos AS INT) AS match_forward, CAST(back AS INT) AS match_reverse,
       CAST(ln AS INT) AS n_ref_peaks, CAST(rank AS INT) AS rank FROM top""", _FINE_VIEWS)
def _measured_manager(spark, sf_dir):
    hits = spectra.search_manager(v.queries(spark, sf_dir, "spectra_fine"), v.library(spark, sf_dir, "spectra_fine"), min_match=600, k=None)
    return hits.select("query_id", "lib_id", "name", "match_factor", "match_forward", "match_reverse", "n_ref_peaks", "rank")


_RI_NAME = """rn AS (SELECT name, ri AS ri_named FROM (SELECT l.name, r.ri, row_number() OVER (PARTITION BY l.name ORDER BY (lower(trim(l.name)) <> lower(r.name)), r.ord) AS k
  FROM (SELECT DISTINCT name FROM {names}) l JOIN ri_ref r ON contains(lower(trim(l.name)), lower(r.name)) OR contains(lower(r.name), lower(trim(l.name)))) x WHERE k = 1)"""

_IDENTIFY = _MANAGER.replace("{limit}", "400") + ", " + _RI_NAME.replace("{names}", "library_rows") + """,
ii AS (SELECT top.*, rn.ri_named, abs(ri_expected - ri_named) AS dd FROM top LEFT JOIN rn ON rn.name = top.name WHERE rank <= 30),
jj AS (SELECT *, CASE WHEN dd IS NULL THEN 0 WHEN dd < 10 THEN 250 WHEN dd < 20 THEN 180 WHEN dd < 35 THEN 100 WHEN dd < 50 THEN 40 WHEN dd < 100 THEN -50 ELSE -150 END AS bonus FROM ii),
kk AS (SELECT *, CASE WHEN dd IS NULL THEN mf ELSE greatest(0, least(999, mf + bonus)) END AS score FROM jj),
ll AS (SELECT *, CASE WHEN dd IS NULL THEN CASE WHEN mf >= 900 THEN 'high' WHEN mf >= 800 THEN 'probable' WHEN mf >= 700 THEN 'tentative' WHEN mf >= 600 THEN 'low' ELSE 'unreliable' END
   WHEN score >= 900 AND dd < 20 THEN 'confirmed' WHEN score >= 800 THEN 'high' WHEN score >= 700 THEN 'probable' WHEN score >= 600 THEN 'tentative'
   WHEN score >= 400 THEN 'low' ELSE 'unreliable' END AS confidence,
   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mf DESC, rank) AS INT) AS place FROM kk)"""


@query("identify", _IDENTIFY + """
SELECT query_id, lib_id, name, CAST(mf AS INT) AS match_factor, CAST(score AS INT) AS combined_score, confidence, round(dd, 1) AS ri_diff, CAST(bonus AS INT) AS ri_bonus,
       concat_ws('|', CASE WHEN dd >= 100 THEN 'RI_MISMATCH' END, CASE WHEN dd < 10 THEN 'RI_CONFIRMED' END, CASE WHEN source = 'builtin_msp' THEN 'CURATED_SPECTRUM' END,
         CASE WHEN cos > 900 THEN 'PURE_MATCH' END, CASE WHEN abs(qtop - ltop) <= 2 THEN 'MOLECULAR_ION_MATCH' END) AS flags, place AS rank
FROM ll WHERE place <= 10""", ("spectra", "library_rows", "ri_ref"))
def _identify(spark, sf_dir):
    found = identify.identify(v.queries(spark, sf_dir), v.library(spark, sf_dir), v.ri_ref(spark, sf_dir))
    return found.select(
        "query_id", "lib_id", "name", "match_factor", "combined_score", "confidence", "ri_diff", "ri_bonus",
        F.array_join("flags", "|").alias("flags"), "rank",
    )


@query("identification_summary", _IDENTIFY + """,
qq AS (SELECT DISTINCT spec_id AS query_id FROM spectra WHERE spec_id % 2 = 1)
SELECT qq.query_id, count(place) AS returned, count(*) FILTER (WHERE confidence = 'confirmed') AS confirmed, count(*) FILTER (WHERE confidence = 'high') AS high,
       count(*) FILTER (WHERE confidence = 'probable') AS probable, arg_min(name, place) AS best_name, CAST(coalesce(arg_min(score, place), 0) AS INT) AS best_score,
       coalesce(arg_min(confidence, place), 'none') AS best_confidence
FROM qq LEFT JOIN (SELECT * FROM ll WHERE place <= 10) l ON l.query_id = qq.query_id GROUP BY qq.query_id""", ("spectra", "library_rows", "ri_ref"))
def _identification_summary(spark, sf_dir):
    q = v.queries(spark, sf_dir)
    found = identify.identify(q, v.library(spark, sf_dir), v.ri_ref(spark, sf_dir))
    return identify.identification_summary(q, found).drop("recommendation")


@query("rt_gate", _MANAGER.replace("{limit}", "450") + """,
a AS (SELECT *, 2 + CAST((query_id * query_id * 31 + query_id * 17) % 30011 AS DOUBLE) / 1000 AS rt,
         CASE WHEN rt_exp < 10 THEN 2.5 WHEN rt_exp < 20 THEN 3.5 ELSE 5.0 END AS base FROM top WHERE rank <= 20),
g AS (SELECT *, CASE WHEN rank = 1 THEN abs(rt - rt_exp) <= base * CASE WHEN mf >= 950 THEN 4 WHEN mf >= 900 THEN 3 WHEN mf >= 800 THEN 2 WHEN mf >= 700 THEN 1.5 ELSE 1 END
     ELSE abs(rt - rt_exp) <= base * CASE WHEN mf >= 900 THEN 3 WHEN mf >= 800 THEN 2 ELSE 1 END END AS ok FROM a)
SELECT query_id, arg_min(lib_id, rank) AS lib_id, CAST(min(rank) AS INT) AS rank FROM g WHERE ok GROUP BY query_id""", _SPECTRA_VIEWS)
def _rt_gate(spark, sf_dir):
    q = v.queries(spark, sf_dir)
    hits = spectra.search_manager(q, v.library(spark, sf_dir), min_match=450)
    i = F.col("query_id")
    times = q.select("query_id", (F.lit(2) + ((i * i * 31 + i * 17) % 30011).cast("double") / 1000).alias("rt"))
    return identify.gate_by_rt(hits, times).select("query_id", "lib_id", "rank")


@query("combine_sources", _MANAGER.replace("{limit}", "450") + """,
u AS (SELECT query_id, name, source, CAST(mf AS INT) AS key FROM top WHERE rank <= 20
      UNION ALL SELECT query_id, name, 'remote' AS source, 100 * count(*) AS key FROM top WHERE rank <= 20 GROUP BY query_id, name),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, source, name) AS rank FROM u)
SELECT query_id, name, source, CAST(key AS INT) AS rank_key FROM r WHERE rank = 1""", _SPECTRA_VIEWS)
def _combine_sources(spark, sf_dir):
    local = spectra.search_manager(v.queries(spark, sf_dir), v.library(spark, sf_dir), min_match=450).select("query_id", "name", "source", "match_factor")
    local = cut_lineage(local)
    remote = local.groupBy("query_id", "name").agg(F.count(F.lit(1)).cast("int").alias("n_spectra")).withColumn("source", F.lit("remote"))
    out = identify.combine_sources(local, remote)
    return out.filter(F.col("rank") == 1).select("query_id", "name", "source", "rank_key")


# ---------------------------------------------------------------- library

@query("library_dedup", """
WITH n AS (SELECT spec_id, count(*) AS n_peaks FROM spectra_all GROUP BY spec_id),
k AS (SELECT lib_id, CASE WHEN cas IS NULL THEN concat('name:', name) ELSE concat('cas:', cas) END AS key, load_seq,
       CASE WHEN cas IS NULL THEN 0 WHEN source = 'builtin_msp' THEN 3 WHEN source = 'msp_file' THEN 2 ELSE 1 END AS pr,
       CASE WHEN cas IS NULL THEN 0 ELSE n_peaks END AS sz, name, cas, source, n_peaks FROM library_all JOIN n ON spec_id = lib_id WHERE n_peaks >= 3)
SELECT lib_id, name, cas, source, CAST(n_peaks AS INT) AS n_peaks FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pr DESC, sz DESC, load_seq) AS r FROM k) x WHERE r = 1""",
    ("spectra_all", "library_all"))
def _dedup(spark, sf_dir):
    return lib_ops.deduplicate(v.whole_library(spark, sf_dir)).select("lib_id", "name", "cas", "source", F.size("peaks").alias("n_peaks"))


@query("library_summary", "SELECT count(*) AS total_entries, count(DISTINCT cas) AS total_unique_cas FROM library_all", ("library_all",))
def _library_summary(spark, sf_dir):
    return lib_ops.summary(v.whole_library(spark, sf_dir))


@query("library_sources", "SELECT source, count(*) AS n FROM library_all GROUP BY source", ("library_all",))
def _library_sources(spark, sf_dir):
    return lib_ops.entries_by_source(v.whole_library(spark, sf_dir))


@query("search_by_name", """
SELECT lib_id, name, cas, formula, source, CAST(coalesce(n, 0) AS INT) AS n_peaks FROM library_all LEFT JOIN (SELECT spec_id, count(*) AS n FROM spectra_all GROUP BY spec_id) ON spec_id = lib_id
WHERE contains(name, 'red') ORDER BY name <> 'red', coalesce(n, 0) DESC, lib_id LIMIT 20""", ("spectra_all", "library_all"))
def _by_name(spark, sf_dir):
    return lib_ops.search_by_name(v.whole_library(spark, sf_dir), " Red ")


@query("search_by_cas", """
SELECT name, cas, formula, source, CAST(coalesce(n, 0) AS INT) AS n_peaks FROM library_all LEFT JOIN (SELECT spec_id, count(*) AS n FROM spectra_all GROUP BY spec_id) ON spec_id = lib_id
WHERE cas = '110-00-8'""", ("spectra_all", "library_all"))
def _by_cas(spark, sf_dir):
    return lib_ops.search_by_cas(v.whole_library(spark, sf_dir), "110-00-8").drop("peaks")


@query("filter_library", """
SELECT lib_id, compound_class, class_confidence FROM library_all WHERE compound_class IN ('food_flavor', 'natural_product', 'other') AND class_confidence >= 0.3""", ("library_all",))
def _filter_library(spark, sf_dir):
    return filters.filter_library(v.whole_library(spark, sf_dir)).select("lib_id", "compound_class", "class_confidence")


@query("usable_entries", "SELECT spec_id AS lib_id, CAST(count(*) AS INT) AS n_peaks FROM spectra_all GROUP BY spec_id HAVING count(*) >= 45", ("spectra_all",))
def _usable(spark, sf_dir):
    return filters.usable_entries(v.whole_library(spark, sf_dir), 45).select("lib_id", F.size("peaks").alias("n_peaks"))


def _part_sql(parts, at_end, inside):
    terms = []
    for p in parts:
        if p.endswith("$"):
            terms.append(f"CASE WHEN ends_with(nm, '{p[:-1]}') THEN {at_end} ELSE 0 END")
        else:
            terms.append(f"CASE WHEN ends_with(nm, '{p}') THEN {at_end} WHEN contains(nm, '{p}') THEN {inside} ELSE 0 END")
    return "CAST(" + " + ".join(terms) + " AS DOUBLE)"


_CLASSIFY = f"""WITH a AS (SELECT lib_id, lower(trim(name)) AS nm, upper(coalesce(formula, '')) AS fm, coalesce(n_peaks, 0) AS n_peaks FROM library_all
   LEFT JOIN (SELECT spec_id, count(*) AS n_peaks FROM spectra_all GROUP BY spec_id) ON spec_id = lib_id),
b AS (SELECT *, {_part_sql(lib_ops.FLAVOR_PARTS, 1.5, 0.5)} AS f0, {_part_sql(lib_ops.PHARMA_PARTS, 2, 1)} AS p0, {_part_sql(lib_ops.INDUSTRIAL_PARTS, 2, 2)} AS i0,
   {_part_sql(lib_ops.NATURAL_PARTS, 1, 1)} AS t0, length(fm) - length(replace(fm, 'N', '')) AS cn, length(fm) - length(replace(fm, 'S', '')) AS cs FROM a),
c AS (SELECT *, p0 + CASE WHEN cn >= 2 THEN cn - 1 ELSE 0 END + CASE WHEN contains(fm, 'P') OR contains(fm, 'CL') OR contains(fm, 'BR') THEN 1 ELSE 0 END AS p1,
   i0 + CASE WHEN contains(fm, 'SI') THEN 3 ELSE 0 END + CASE WHEN cs > 0 AND f0 <= 0 THEN 0.5 ELSE 0 END AS i1,
   f0 + CASE WHEN cs > 0 AND f0 > 0 THEN 1 ELSE 0 END + CASE WHEN n_peaks > 0 AND n_peaks < 15 THEN 0.3::DOUBLE ELSE 0 END AS f1 FROM b),
d AS (SELECT *, list_sort([f1, p1, i1, t0], 'DESC') AS s FROM c),
e AS (SELECT lib_id, CASE WHEN s[1] <= 0.5 THEN 'other' WHEN f1 = s[1] THEN 'food_flavor' WHEN p1 = s[1] THEN 'pharmaceutical' WHEN i1 = s[1] THEN 'industrial' ELSE 'natural_product' END AS compound_class,
   round(least(1.0, (s[1] - s[2]) / 3.0 + 0.3), 6) AS class_confidence FROM d)"""


@query("classify", _CLASSIFY + " SELECT * FROM e", ("spectra_all", "library_all"))
def _classify(spark, sf_dir):
    return rounded(lib_ops.classify(v.whole_library(spark, sf_dir)).select("lib_id", "compound_class", "class_confidence"))


@query("class_shares", _CLASSIFY + " SELECT compound_class, count(*) AS n, round(count(*) / (SELECT count(*) FROM e) * 100, 1) AS pct FROM e GROUP BY compound_class", ("spectra_all", "library_all"))
def _class_shares(spark, sf_dir):
    return lib_ops.class_shares(lib_ops.classify(v.whole_library(spark, sf_dir)))


_RULES = [("metal", ["bolt", "gear", "ring"]), ("colour", ["red", "blue"]), ("size", ["small", "large"])]


@query("categorize", """
SELECT CASE WHEN regexp_matches(lower(name), 'bolt|gear|ring') THEN 'metal' WHEN regexp_matches(lower(name), 'red|blue') THEN 'colour'
            WHEN regexp_matches(lower(name), 'small|large') THEN 'size' ELSE 'other/niche' END AS category, count(*) AS n FROM library_all GROUP BY 1""", ("library_all",))
def _categorize(spark, sf_dir):
    return lib_ops.category_counts(v.whole_library(spark, sf_dir), _RULES)


# Keywords cut out of all names, by the hundred, in 25 categories; a keyword of several rules counts for the first.
_EXTRA["keyword_rules"] = """
SELECT CAST(p_partkey AS BIGINT) AS priority, concat('class ', CAST(p_partkey % 25 AS STRING)) AS category,
       substr(p_name, 1 + p_partkey % 5, 3 + p_partkey % 4) AS keyword FROM part"""


@query("categorized_names", """
SELECT o.name, coalesce(arg_min(r.category, r.priority), 'other/niche') AS category FROM odd_names o
LEFT JOIN keyword_rules r ON contains(lower(o.name), lower(r.keyword)) AND r.keyword <> '' GROUP BY o.name""", ("odd_names", "keyword_rules"))
def _categorized(spark, sf_dir):
    return lib_ops.categorized(extra(spark, sf_dir, "odd_names"), extra(spark, sf_dir, "keyword_rules"))


@query("category_table", """
WITH c AS (SELECT l.lib_id, coalesce(arg_min(r.category, r.priority), 'other/niche') AS category FROM library_all l
  LEFT JOIN keyword_rules r ON contains(lower(l.name), lower(r.keyword)) AND r.keyword <> '' GROUP BY l.lib_id)
SELECT category, count(*) AS n FROM c GROUP BY category""", ("library_all", "keyword_rules"))
def _category_table(spark, sf_dir):
    return lib_ops.counts_by_rules(v.view(spark, sf_dir, "library_all"), extra(spark, sf_dir, "keyword_rules"))


# ---------------------------------------------------------------- retention index

_ANCHORS = """WITH st AS (SELECT min(sample) AS s FROM (SELECT sample FROM standards WHERE regexp_matches(compound, 'c8|c9|c10|c12|c14|c16|c18|c20|c22|c24|c26|c28|c30')
   GROUP BY sample HAVING count(DISTINCT compound) >= 5) x),
an AS (SELECT CAST(substr(compound, 2) AS INT) AS carbon, min(rt) AS rt FROM standards, st WHERE sample = s AND area >= 1000
   AND CAST(substr(compound, 2) AS INT) IN (8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 22, 24, 26, 28, 30) GROUP BY compound)"""


@query("named_anchors", _ANCHORS + " SELECT carbon, rt FROM an", ("standards",))
def _named_anchors(spark, sf_dir):
    return kovats.named_anchors(extra(spark, sf_dir, "standards"))


# A standard run with well separated peaks: one per size of a part, in the order of the sizes, and small ones in between.
_EXTRA["ladder"] = """
SELECT 'Ladder.D' AS sample, concat('RT_', CAST(p_size AS STRING)) AS compound, CAST(900 + count(*) * 5 AS DOUBLE) AS area,
       2 + CAST(p_size * 610 + (p_size * p_size * 7) % 190 AS DOUBLE) / 1000 AS rt FROM part GROUP BY p_size"""


@query("spaced_anchors", """
WITH RECURSIVE f AS (SELECT DISTINCT rt FROM ladder WHERE area >= 1000),
s AS (SELECT median(d) * 0.6 AS step FROM (SELECT rt - lag(rt) OVER (ORDER BY rt) AS d FROM f) g WHERE d > 0.5),
w AS (SELECT 8 AS carbon, min(rt) AS rt FROM f UNION ALL
      SELECT carbon + 1, (SELECT min(f.rt) FROM f, s WHERE f.rt - w.rt > step) FROM w WHERE carbon < 30 AND w.rt IS NOT NULL)
SELECT carbon, rt FROM w WHERE rt IS NOT NULL""", ("ladder",))
def _spaced_anchors(spark, sf_dir):
    return kovats.spaced_anchors(extra(spark, sf_dir, "ladder"))


@query("kovats_ri", _ANCHORS + """,
o AS (SELECT rt AS x0, carbon * 100.0::DOUBLE AS y0, lead(rt) OVER (ORDER BY rt) AS x1, lead(carbon) OVER (ORDER BY rt) * 100.0::DOUBLE AS y1,
             row_number() OVER (ORDER BY rt) AS k, count(*) OVER () AS n FROM an),
g AS (SELECT * FROM o WHERE k < n),
d AS (SELECT DISTINCT rt FROM peaks)
SELECT rt, round(greatest(100.0, least(5000.0, y0 + (y1 - y0) / (x1 - x0) * (rt - x0))), 1) AS ri
FROM d JOIN g ON (k = 1 OR rt > x0) AND (k = n - 1 OR rt <= x1)""", ("standards", "peaks"))
def _kovats(spark, sf_dir):
    anchors = kovats.named_anchors(extra(spark, sf_dir, "standards"))
    return kovats.calibrate(v.peaks(spark, sf_dir), anchors).select("rt", "ri").distinct()


@query("ri_crossref", """
WITH t AS (SELECT DISTINCT compound, ri FROM named_peaks WHERE ri > 0),
h AS (SELECT t.compound, t.ri, r.name, r.ri AS rr, row_number() OVER (PARTITION BY t.compound, t.ri ORDER BY ord) AS k
      FROM t JOIN ri_ref r ON (contains(t.compound, r.name) OR contains(r.name, t.compound)) AND abs(t.ri - r.ri) < 50)
SELECT compound, ri AS ri_measured, rr AS ri_database, name AS db_match, round(abs(ri - rr), 1) AS ri_diff,
       CASE WHEN abs(ri - rr) < 20 THEN 'high' WHEN abs(ri - rr) < 35 THEN 'medium' ELSE 'low' END AS confidence FROM h WHERE k = 1""", ("named_peaks", "ri_ref"))
def _crossref(spark, sf_dir):
    return kovats.cross_reference(extra(spark, sf_dir, "named_peaks"), v.ri_ref(spark, sf_dir))


@query("ri_by_name", "WITH " + _RI_NAME.replace("{names}", "odd_names") + " SELECT name, ri_named AS ri_expected FROM rn", ("odd_names", "ri_ref"))
def _ri_by_name(spark, sf_dir):
    return kovats.index_by_name(extra(spark, sf_dir, "odd_names"), v.ri_ref(spark, sf_dir))


@query("ri_stats", "SELECT count(*) AS size, min(ri) AS ri_min, max(ri) AS ri_max, round(avg(ri), 1) AS mean_ri, round(median(ri), 1) AS median_ri FROM ri_ref", ("ri_ref",))
def _ri_stats(spark, sf_dir):
    return kovats.ri_stats(v.ri_ref(spark, sf_dir))


# ---------------------------------------------------------------- enrichment

_PAGE_CELL = r'[=/](\d{2,4})[^0-9A-Za-z]'


@query("page_values", r"""
WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '[=/](\d{2,4})[^0-9A-Za-z]', 1)) AS s FROM pages WHERE contains(html, '<p>') OR contains(html, 'href')),
d AS (SELECT DISTINCT page_id, CAST(s AS DOUBLE) AS x FROM m WHERE CAST(s AS DOUBLE) > 10 AND CAST(s AS DOUBLE) < 4000),
r AS (SELECT page_id, x, row_number() OVER (PARTITION BY page_id ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY page_id) AS n FROM d)
SELECT p.page_id, CAST(coalesce(max(n), 0) AS INT) AS n, max(x) FILTER (WHERE k = n // 2) AS ri FROM pages p LEFT JOIN r ON r.page_id = p.page_id GROUP BY p.page_id""", ())
def _page_values(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return enrichment.page_values(pages, "html", ["<p>", "href"], _PAGE_CELL, 10, 4000).select("page_id", "n", "ri")


@query("response_ids", """
SELECT p_partkey AS resp_id, CASE WHEN p_size % 3 = 0 THEN '77-77-7' ELSE concat(100 + p_partkey % 900, '-0', p_size % 10, '-', p_size % 7) END AS cas,
       CASE WHEN p_size % 4 <> 0 THEN upper(replace(p_name, ' ', '-')) END AS inchikey FROM part""", ())
def _response_ids(spark, sf_dir):
    r = extra(spark, sf_dir, "responses")
    return enrichment.first_inchikey(enrichment.first_cas(r), "props").select("resp_id", "cas", "inchikey")


@query("enrichment_worklist", """
SELECT lib_id, name FROM library_all l WHERE cas IS NULL AND length(trim(name)) BETWEEN 3 AND 100
AND lower(trim(name)) NOT IN (SELECT lower(name) FROM ri_ref WHERE ri > 2500) AND lower(trim(name)) NOT IN (SELECT lower(name) FROM ri_ref WHERE ri < 1000)""", ("library_all", "ri_ref"))
def _worklist(spark, sf_dir):
    refs = v.ri_ref(spark, sf_dir)
    return enrichment.worklist(
        v.whole_library(spark, sf_dir), refs.filter("ri > 2500"), refs.filter("ri < 1000"), missing="cas"
    ).select("lib_id", "name")


@query("ri_upsert", """
WITH n AS (SELECT name, max(ri_exp) AS ri FROM library_all WHERE ri_exp IS NOT NULL GROUP BY name)
SELECT name, ri FROM n UNION ALL SELECT name, ri FROM ri_ref WHERE name NOT IN (SELECT name FROM n)""", ("library_all", "ri_ref"))
def _upsert(spark, sf_dir):
    new = v.whole_library(spark, sf_dir).filter("ri_exp IS NOT NULL").groupBy("name").agg(F.max("ri_exp").alias("ri"))
    return enrichment.upsert(new, v.ri_ref(spark, sf_dir).select("name", "ri"))


@query("enrichment_progress", """
WITH w AS (SELECT DISTINCT name FROM library_all), r AS (SELECT name, n >= 32 AS found FROM ri_ref WHERE ri > 2000)
SELECT count(*) AS checked, count(*) FILTER (WHERE found) AS found, round(count(*) FILTER (WHERE found) * 100.0 / count(*), 1)::DOUBLE AS hit_rate_pct,
       (SELECT count(*) FROM w WHERE name NOT IN (SELECT name FROM r)) AS remaining FROM r""", ("library_all", "ri_ref"))
def _progress(spark, sf_dir):
    results = v.ri_ref(spark, sf_dir).filter("ri > 2000").select("name", (F.col("n") >= 32).alias("found"))
    return enrichment.progress(v.whole_library(spark, sf_dir).select("name").distinct(), results)


@query("msp_roundtrip", """
SELECT l.name, l.cas, l.formula, l.ri_exp, l.compound_class, CAST(count(s.spec_id) AS INT) AS n_peaks, CAST(coalesce(sum(mz * intensity), 0) AS BIGINT) AS checksum
FROM library_all l LEFT JOIN spectra_all s ON s.spec_id = l.lib_id GROUP BY l.lib_id, l.name, l.cas, l.formula, l.ri_exp, l.compound_class""", ("spectra_all", "library_all"))
def _msp_roundtrip(spark, sf_dir):
    from peakloom.sources import libraries, sinks

    text = sinks.msp_text(v.whole_library(spark, sf_dir))
    back = libraries.parse_msp(libraries.msp_records(text))
    return back.select(
        "name", "cas", "formula", "ri_exp", "compound_class", F.size("peaks").alias("n_peaks"),
        F.aggregate("peaks", F.lit(0).cast("long"), lambda a, p: a + (p["mz"] * p["intensity"]).cast("long")).alias("checksum"),
    )
