"""Documents that stay when doc_ids repeat or are missing."""

from __future__ import annotations

from tests.llm.test_operators import BASE, NEAR, prose

from peakloom.llm import near_dedup


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(df).collect()), key=str)


def test_unrelated_texts_with_one_id_all_stay(spark):
    one, two = prose(21, 120), prose(22, 120)
    rows = [(5, one), (5, two), (6, two.replace("\n", "  ")), (7, BASE), (8, NEAR)]
    assert kept(spark, rows) == sorted([(5, one), (5, two), (7, BASE)], key=str)


def test_near_copies_without_ids_leave_one(spark):
    other = prose(23, 120)
    found = kept(spark, [(None, BASE), (None, NEAR), (None, BASE), (None, other)])
    assert len(found) == 2 and (None, other) in found


def test_row_with_an_id_goes_before_one_without(spark):
    assert kept(spark, [(None, BASE), (9, NEAR), (9, BASE)]) in ([(9, BASE)], [(9, NEAR)])
