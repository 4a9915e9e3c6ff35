"""Named queries against their check SQL at the smallest scale. PEAKLOOM_FULL=1 runs all of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_catalogue import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "compare_groups", "rank_sums", "descriptive", "composition", "quality_score", "boxplot", "correlation_pearson",
    "correlation_spearman", "align_rt", "match_rt_library", "vendor_merge", "scans_within", "find_peaks", "detect_peaks",
    "spectrum_search_hybrid", "spectrum_search_manager", "identify", "library_dedup", "classify", "kovats_ri", "ri_crossref",
    "page_values", "msp_roundtrip",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()) if os.environ.get("PEAKLOOM_FULL") else SOME)
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
