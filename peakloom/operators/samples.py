"""Sample naming, grouping and the single-sample profile: P1-P5."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Words in a sample name that split a group, in order of precedence, and the sample number pattern.
SUB_GROUP_WORDS = ["液体", "凝胶", "蛋黄"]
SAMPLE_NUMBER = r"(\d+)\s*唐|(\d+)\s*\.D"


def _sample_tests(samples: str) -> tuple[Column, Column]:
    """Exact and containment test of the sample column against 'a,b' and '1-8' parts."""
    sample = F.col("sample")
    stem = F.replace(sample, F.lit(".D"), F.lit(""))
    exact, fuzzy = F.lit(False), F.lit(False)
    for part in [p.strip() for p in samples.split(",") if p.strip()]:
        span = re.match(r"^(\d+)\s*-\s*(\d+)$", part)
        if span:
            lo, hi = int(span.group(1)), int(span.group(2))
            if lo > hi:
                continue
            number = F.expr("try_cast(regexp_extract(sample, '^Sample([0-9]+)([.]D)?$', 1) AS BIGINT)")
            spelled = F.format_string("Sample%03d", number)
            exact = exact | F.coalesce(number.between(lo, hi) & stem.eqNullSafe(spelled), F.lit(False))
            fuzzy = fuzzy | F.exists(
                F.sequence(F.lit(lo), F.lit(hi)),
                lambda n: sample.contains(F.format_string("Sample%03d", n))
                | F.format_string("Sample%03d.D", n).contains(stem),
            )
        else:
            name = part if part.endswith(".D") else part + ".D"
            bare = name.replace(".D", "")
            exact = exact | sample.isin(name, bare)
            fuzzy = fuzzy | sample.contains(bare) | F.lit(name).contains(stem)
    return exact, fuzzy


def set_groups(peaks: DataFrame, group_name: str, samples: str) -> DataFrame:
    """Put samples in a named group; containment counts only when no sample matches exactly.

    The list becomes a predicate, so nothing is joined; whether any sample matches exactly is one scalar subquery.
    """
    exact, fuzzy = _sample_tests(samples)
    any_exact = peaks.agg(F.coalesce(F.bool_or(exact), F.lit(False)).alias("any_exact")).scalar()
    return peaks.withColumn("grp", F.when(F.when(any_exact, exact).otherwise(fuzzy), F.lit(group_name)).otherwise(F.col("grp")))


def sub_group(words: Sequence[str] = SUB_GROUP_WORDS) -> Column:
    """P2."""
    out = None
    for word in words:
        test, value = F.col("sample").contains(word), F.concat(F.col("grp"), F.lit(f" - {word}"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.col("grp"))


def sample_number(pattern: str = SAMPLE_NUMBER, default: int = 999) -> Column:
    """The first alternative that matched, else 999."""
    found = [F.nullif(F.regexp_extract("sample", pattern, i), F.lit("")) for i in (1, 2)]
    return F.coalesce(F.coalesce(*found).try_cast("int"), F.lit(default))


def display_label(prefix: str | None = None) -> Column:
    """Sample name without the .D suffix and without a lab prefix."""
    label = F.regexp_replace("sample", r"\.D$", "")
    return F.replace(label, F.lit(prefix), F.lit("")) if prefix else label


def with_sample_columns(peaks: DataFrame) -> DataFrame:
    return peaks.withColumns({"sub_group": sub_group(), "sample_num": sample_number(), "label": display_label()})


def sample_profile(peaks: DataFrame, sample_name: str) -> DataFrame:
    """P5: compounds of the first sample matching a case-insensitive pattern, else its first number.

    Concentrations of a compound listed twice are summed, so the shares add up to 100.
    """
    wanted = peaks.filter(F.col("sample").rlike(f"(?i){sample_name}")).agg(F.min("sample").alias("s")).scalar()
    number = re.search(r"\d+", sample_name)
    if number:
        backup = peaks.filter(F.col("sample").contains(number.group(0))).agg(F.min("sample").alias("s")).scalar()
        wanted = F.coalesce(wanted, backup)
    rows = peaks.filter((F.col("sample") == wanted) & F.col("compound").isNotNull())
    # a compound listed twice has its earliest time and the sums of area and concentration
    table = rows.groupBy("grp", "sample", "compound").agg(
        F.sum("conc").alias("conc"), F.min("rt").alias("rt"), F.sum("area").alias("area")
    )
    total = rows.agg(F.sum("conc").alias("total")).scalar()
    return table.withColumn(
        "pct_of_total", F.round(F.coalesce(F.col("conc") / F.when(total > 0, total) * 100, F.lit(0.0)), 2)
    )


def profile_top(profile: DataFrame, k: int = 5) -> DataFrame:
    return profile.orderBy(F.desc("conc"), "compound").limit(k)
