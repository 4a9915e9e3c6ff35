"""Size of the training set of the quality model."""

from __future__ import annotations

from peakloom.llm import quality


def test_eight_thousand_ratings_are_used(spark):
    df = spark.range(8500).selectExpr("id as doc_id", "concat('text number ', id) as text")
    ratings = spark.range(8500).selectExpr("id as doc_id", "cast(id % 3 as int) as grade")
    _, _, grades = quality.training_rows(df, ratings)
    assert len(grades) == 8000
