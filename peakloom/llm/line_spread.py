"""Removal of lines that stand on many sites.

Every normalised line gets a HyperLogLog sketch of its sites; sketches are merged by aggregation. Lines whose estimate
is near the threshold are counted exactly, the rest are far enough for the estimate to be sure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from peakloom.llm.common import NOT_SPACE, digest, fresh, normal_line, row_key, whole_text
from peakloom.session import cut_lineage

LG_K = 12


def _lines(df: DataFrame, site: str) -> DataFrame:
    return df.select(
        "doc_id", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("_site"), row_key().alias("_key"),
        F.posexplode(F.split(whole_text(), "\n")).alias("_pos", "_line"),
    ).filter(F.col("_line").rlike(NOT_SPACE)).select("doc_id", "_site", "_key", "_pos", digest(normal_line(F.col("_line"))).alias("line"))


def spread_lines(df: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """(line digest, first_doc) of the lines on at least ``min_sites`` distinct sites; first_doc is the smallest doc_id.

    The standard error of a sketch is 1.04 / 2^(LG_K / 2). Estimates within eight errors (and one) of the threshold are
    replaced by exact counts, so the result equals an exact count for all lines.
    """
    lines = _lines(df, site)
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("_site", LG_K).alias("sketch"), F.min("doc_id").alias("first_doc"))
    slack = min_sites * 8 * 1.04 / 2 ** (LG_K / 2) + 1
    wide = cut_lineage(
        sketches.select("line", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - slack)
    )
    near = wide.filter(F.col("sites") <= min_sites + slack)
    exact = (
        lines.select("line", "_site").join(near.select("line"), "line", "left_semi").distinct()
        .groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites)
    )
    sure = wide.filter(F.col("sites") > min_sites + slack).select("line", "first_doc")
    return sure.union(near.join(exact, "line", "left_semi").select("line", "first_doc"))


def remove_spread_lines(df: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """All columns of ``df`` with ``text`` cleaned, plus n_lines and n_removed_lines (columns of these names are replaced).

    A line on ``min_sites`` sites or more is removed everywhere but in the document with the smallest doc_id that has it,
    so no content is lost from the corpus. Lines without a word are never counted or removed. A null text stays null, a
    null site counts as one site, a null doc_id is never the first. Equal rows get equal results; an empty table gives
    no rows.
    """
    spread = cut_lineage(spread_lines(df, site, min_sites))
    gone = F.col("first_doc").isNull() | ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    key, lost, all_lines = fresh(df, "_key", "_lost", "_lines")
    removed = (
        _lines(df, site).join(spread, "line").filter(gone).groupBy(F.col("_key").alias(key)).agg(F.collect_set("_pos").alias(lost))
    )
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(lost)), lambda i: F.get(F.col(all_lines), i)
    )
    names = [c for c in df.columns if c not in ("n_lines", "n_removed_lines")]
    joined = df.select(*[F.col(f"`{c}`") for c in names], row_key().alias(key)).join(removed, key, "left").withColumn(all_lines, F.split(whole_text(), "\n"))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return joined.select(
        *[text if c == "text" else F.col(f"`{c}`") for c in names],
        F.size(F.filter(all_lines, lambda x: x.rlike(NOT_SPACE))).cast("long").alias("n_lines"),
        F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("long").alias("n_removed_lines"),
    )
