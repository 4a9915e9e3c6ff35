"""From raw documents to packed training sequences, in five stages over everything the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from peakloom.llm import line_spread, near_dedup, packing, quality, secret_links
from peakloom.llm.common import documents
from peakloom.llm.queries import ratings, token_pattern, vocabulary
from peakloom.session import cut_lineage


def _with_size(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the input, with n_chars of the text as it is now."""
    size = F.char_length("text").cast(dict(df.dtypes).get("n_chars", "long")).alias("n_chars")
    return df.select(*[size if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches one half stay."""
    return quality.classify(docs, ratings(spark, sf_dir)).filter("accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites go, but for the first document with each; a document that consisted of them alone goes too."""
    cleaned = line_spread.remove_spread_lines(docs)
    left = cleaned.filter("n_removed_lines = 0 or n_removed_lines < n_lines")
    return _with_size(left, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark; the documents stay."""
    return _with_size(secret_links.redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), token_pattern())


STAGES = [
    ("quality", select_quality),
    ("line_dedup", remove_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No stage but line removal can be written in SQL; tests/llm/test_pipeline.py follows rows through all stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
