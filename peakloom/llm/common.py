"""Helpers shared by the text operators: reading, row keys and expressions without side effects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text() -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def row_key() -> Column:
    """16 bytes that identify (doc_id, text). Equal rows share the key, and every result here is the same for them."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\x1f"), whole_text())))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))


def normal_line(line: Column) -> Column:
    """A line with runs of white space made one space and none at its ends."""
    return F.trim(F.regexp_replace(line, f"{SPACE}+", " "))


def digest(value: Column) -> Column:
    """128-bit digest as bytes: at 10^12 lines a collision has a chance below 10^-14."""
    return F.unhex(F.md5(value))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not, made from ``names`` by adding underscores."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
