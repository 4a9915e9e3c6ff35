"""The block matcher against the definition: every pair, every ion, whatever the index leaves out must stay below the limit."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from peakloom.operators import ionmatch
from test_spectra import ion_match

PEAKS = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.int32())]))
ION = st.tuples(st.one_of(st.integers(40, 46).map(float), st.floats(40, 46).map(lambda x: round(x, 2))), st.integers(0, 999))
SPECTRA = st.lists(st.lists(ION, max_size=8), min_size=1, max_size=6)


def table(spectra, **columns):
    peaks = pa.array([[{"mz": m, "intensity": i} for m, i in s] for s in spectra], PEAKS)
    return pa.table({"peaks": pa.chunked_array([peaks]), **columns})


def plain(mode, query, ref, tolerance):
    dot, matched = ion_match(query, ref, tolerance)
    back, matched_back = ion_match(ref, query, tolerance)
    qs, rs = sum(i * i for _, i in query), sum(i * i for _, i in ref)
    if not matched or not qs or not rs:
        return None
    score = ionmatch.best_score(mode, *map(np.float64, (dot, back, matched, matched_back, len(ref))), len(query), np.float64(rs), float(qs))
    return float(score), (dot, matched, back, matched_back)


@pytest.mark.parametrize("mode", ["cosine", "forward", "reverse", "hybrid", "mean", "either"])
@settings(max_examples=120, deadline=None)
@given(SPECTRA, SPECTRA, st.sampled_from([1, 300, 600, 850, 999]), st.sampled_from([0.5, 0.3, 1.0, 0.05]))
def test_pairs_equal_all_pairs(mode, library, queries, limit, tolerance):
    got = {}
    for q, entries, sums in ionmatch.pairs(table(library), table(queries), mode, limit, tolerance, True, False):
        for at, e in enumerate(entries.tolist()):
            got[q, e] = tuple(int(s[at]) for s in sums)
    want = {}
    for q, query in enumerate(queries):
        for e, ref in enumerate(library):
            found = plain(mode, query, ref, tolerance) if query and ref else None
            if found and found[0] >= limit - ionmatch.SLACK:
                want[q, e] = found[1]
    assert got == want


def test_index_keeps_only_what_a_hit_needs():
    rng = np.random.default_rng(2)
    strong = [[(50.0 + 10 * k, 999) for k in range(3)] + [(200.0 + k, 5) for k in range(60)] for _ in range(20)]
    lib = ionmatch.Spectra.read(table(strong).column("peaks"))
    index = lib.needed("cosine", 700, 0.4, 3e6, 1.0)
    assert len(index) <= 3 * 20 and set(lib.mz[index]) <= {50.0, 60.0, 70.0}
    assert len(lib.needed("cosine", 1, 0.4, 3e6, 1.0)) == len(lib.mz)
    queries = [[(float(m), int(i)) for m, i in zip(rng.uniform(200, 260, 30), rng.integers(1, 999, 30))]]
    assert not list(ionmatch.pairs(table(strong), table(queries), "cosine", 700, 0.4, False, False))


def test_slabs_cover_all_entries(monkeypatch):
    monkeypatch.setattr(ionmatch, "CELLS", 50)
    rng = np.random.default_rng(4)
    spectra = [[(float(m), 5) for m in rng.uniform(40, 50, rng.integers(1, 20))] for _ in range(30)]
    seen = {(q, e) for q, entries, _ in ionmatch.pairs(table(spectra), table(spectra[:3]), "cosine", 1, 0.5, True, False) for e in entries.tolist()}
    assert {(q, e) for q in range(3) for e in range(30) if ion_match(spectra[q], spectra[e])[1]} == seen


def test_empty_sides_and_null_values():
    none = table([])
    assert not list(ionmatch.pairs(none, table([[(41.0, 9)]]), "cosine", 1, 0.5, True, False))
    assert not list(ionmatch.pairs(table([[(41.0, 9)]]), none, "cosine", 1, 0.5, True, False))
    holes = table([None or [], [(41.0, None), (None, 9), (42.0, 3)]])
    (found,) = ionmatch.pairs(holes, table([[(42.0, 3)]]), "cosine", 1, 0.5, True, False)
    assert found[1].tolist() == [1] and [int(s[0]) for s in found[2]] == [9, 1, 9, 1]


@pytest.mark.parametrize("mode", ["mean", "either", "hybrid", "forward"])
@settings(max_examples=150, deadline=None)
@given(SPECTRA, SPECTRA, st.sampled_from([1, 300, 600, 850]), st.sampled_from([0.5, 0.3, 1.0, 0.0]))
def test_tables_in_both_directions_equal_all_pairs(mode, library, queries, limit, tolerance):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ionmatch, "FEW_QUERIES", 1)
        m.setattr(ionmatch, "FEW_PLACES", 0)
        m.setattr(ionmatch, "CELLS", 16)
        test_pairs_equal_all_pairs.hypothesis.inner_test(mode, library, queries, limit, tolerance)


def dense(rng, n):
    return [[(round(40 + 0.7 * k + float(rng.uniform(0, 0.97)), 3), int(rng.integers(1, 999))) for k in range(48)] for _ in range(n)]


@pytest.mark.parametrize("mode", ["mean", "either"])
def test_dense_blocks_are_not_matched_pair_by_pair(monkeypatch, mode):
    """every ion of a block is looked up once per spectrum of the other side, not once per pair and direction."""
    rng = np.random.default_rng(7)
    library, queries = table(dense(rng, 60)), table(dense(rng, 40))
    run = lambda **more: {
        (q, e): (int(s[0][at]), int(s[2][at]))
        for q, entries, s in ionmatch.pairs(library, queries, mode, 300, 0.5, True, False, **more) for at, e in enumerate(entries.tolist())
    }
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ionmatch, "FEW_QUERIES", 1000, raising=False)
        want = run()
    monkeypatch.setattr(ionmatch, "_sums", None)
    assert len(want) > 1000 and run() == want and run(counts=False) == want


def test_tables_over_few_places_are_built_without_a_step_per_spectrum(monkeypatch):
    """whole m/z are laid out for all spectra of a block together; counts that no score uses are left out."""
    rng = np.random.default_rng(8)
    whole = lambda n: [[(40.0 + k, int(rng.integers(1, 999))) for k in np.flatnonzero(rng.random(40) < 0.6)] for _ in range(n)]
    spectra, others = [*whole(50), [], *whole(3)], whole(20)
    monkeypatch.setattr(ionmatch, "_partners", None)
    bases = [int(max(s, key=lambda p: p[1])[0]) if s else 0 for s in spectra]
    wanted = [[], [999], *[[45, 50, 61, 70]] * 18]
    library = table(spectra, base_peak_mz=pa.array(bases, pa.int32()))
    queries = table(others, cand=pa.array(wanted, pa.list_(pa.int32())))
    for counts in (True, False):
        got = {
            (q, e): tuple(int(s[at]) for s in sums)
            for q, entries, sums in ionmatch.pairs(library, queries, "mean", 300, 0.5, True, True, None, counts) for at, e in enumerate(entries.tolist())
        }
        want = {}
        for q, query in enumerate(others):
            for e, ref in enumerate(spectra):
                found = plain("mean", query, ref, 0.5) if ref and (not wanted[q] or bases[e] in wanted[q]) else None
                if found and found[0] >= 300 - ionmatch.SLACK:
                    want[q, e] = found[1] if counts else (found[1][0], 0, found[1][2], 0)
        assert got == want and want
