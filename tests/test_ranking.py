"""Hits ranked inside their task against plain Python."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_spectra import L, Q, scores

from peakloom.operators import ranking, spectra


def _spectra(rng, n):
    return [[(float(m), int(i)) for m, i in zip(np.sort(rng.uniform(40, 52, 6)).round(1), rng.integers(1, 1000, 6))] for _ in range(n)]


def _tables(spark, queries, library):
    return spark.createDataFrame(queries, Q), spark.createDataFrame(library, "load_seq int, " + L)


@pytest.mark.parametrize("name", ["search", "fast", "manager"])
def test_hits_are_not_shuffled(spark, name):
    """Hits leave the task that finds them with their rank; only queries and library are dealt."""
    rng = np.random.default_rng(3)
    q, lib = _tables(
        spark, [(i, p, None) for i, p in enumerate(_spectra(rng, 8))],
        [(i, i, f"c{i}", None, "x", None, None, p) for i, p in enumerate(_spectra(rng, 8))],
    )
    hits = spectra.search_manager(q, lib, k=None) if name == "manager" else spectra.search(q, lib, profile="fast" if name == "fast" else "nist")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert "Window" not in plan and "hashpartitioning" not in above and "rangepartitioning" not in above and below.count("hashpartitioning") == 1


@pytest.mark.parametrize("most", [1, 40, 24_000_000])
def test_ranks_with_repeated_and_missing_keys_equal_plain_python(spark, monkeypatch, most):
    """Rows of one query_id are ranked together, an entry whose lib_id repeats meets each row of that id, and a null lib_id none."""
    monkeypatch.setattr(ranking, "PAIRS", most)
    rng = np.random.default_rng(9)
    queries = [(i % 7 if i % 5 else None, p, 900.0 + 20 * i if i % 3 else None) for i, p in enumerate(_spectra(rng, 12))]
    library = [
        (int(at), None if i == 3 else 1 if i == 2 else i, f"c{i}", 880.0 + 25 * i if i % 4 else None, "x", ("food_flavor", "industrial", None)[i % 3], i / 20, p)
        for i, (at, p) in enumerate(zip(rng.permutation(20), _spectra(rng, 20)))
    ]
    library[2] = (*library[2][:7], library[1][7])  # both rows of an id hold the same ions
    q, lib = _tables(spark, queries, library)

    def penalty(a, b):
        d = None if a is None or b is None else abs(a - b)
        return 1.0 if d is None or d <= 50 else 1.0 - 0.5 * (d - 50) / 50 if d <= 100 else 0.5 - 0.4 * (d - 100) / 100 if d <= 200 else 0.1

    def weight(c, conf):
        return 1.05 + 0.15 * conf if c == "food_flavor" else 0.75 - 0.1 * min(conf, 1.0) if c == "industrial" else 1.0

    want = {}
    for key, peaks, expected in queries:
        for row in library:
            for other in library:
                if row[1] is not None and row[1] == other[1] and (mf := scores(peaks, row[7])["hybrid"]) >= 200:
                    pen = penalty(other[3], expected)
                    want.setdefault(key, []).append((int(mf * pen * weight(other[5], other[6])), other[0], mf, other[3], expected, pen))
    ranks = {}
    for key, found in want.items():
        found.sort(key=lambda h: (-h[0], h[1]))
        backed = next((i for i, h in enumerate(found) if h[3] is not None), 0)
        first = found[backed]
        if backed and first[4] is not None and first[2] >= found[0][2] - 80 and first[5] >= 0.9:
            found.insert(0, found.pop(backed))
        ranks[key] = [(h[0], h[2]) for h in found]
    got = {}
    for r in sorted(spectra.search(q, lib, min_match=200, category_boost=True, block_ions=30).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["effective_match"], r["match_factor"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == ranks and None in got and any(len(x) > 20 for x in got.values())


def test_blocks_hold_all_rows_in_order_and_few_ions(tmp_path):
    rng = np.random.default_rng(1)
    sizes = [int(n) for n in rng.integers(0, 12, 200)] + [500, 0, 1]
    peaks = pa.array([[{"mz": 40.0, "intensity": 1}] * n for n in sizes])
    files = []
    for at, (start, stop) in enumerate([(0, 90), (90, 90), (90, len(sizes))]):
        pq.write_table(pa.table({"entry": range(start, stop), "peaks": peaks.slice(start, stop - start)}), tmp_path / f"part {at}.parquet", row_group_size=37)
        files.append((tmp_path / f"part {at}.parquet").as_uri())
    found = list(ranking.blocks(files, ["entry", "peaks"], 50))
    assert [e for b in found for e in b.column("entry").to_pylist()] == list(range(len(sizes)))
    ions = [sum(len(p) for p in b.column("peaks").to_pylist()) for b in found]
    assert sum(ions) == sum(sizes) and sorted(ions)[-2] <= 62 and len(found) < 60


def test_empty_sides_give_no_hits(spark):
    some = _spectra(np.random.default_rng(2), 3)
    queries, library = [(i, p, None) for i, p in enumerate(some)], [(i, i, f"c{i}", None, "x", None, None, p) for i, p in enumerate(some)]
    for mine, entries in ((queries, []), ([], library), ([(1, [], None)], library)):
        q, lib = _tables(spark, mine, entries)
        assert not spectra.search(q, lib, min_match=1).collect() and not spectra.search_manager(q, lib, min_match=1).collect()
