"""Periodic runs against the definition, tried for every stretch and period."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from peakloom.llm import periodic_runs, queries


def plain_runs(words):
    """Maximal stretches of every period, kept if no smaller period gives the same stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=0, max_size=60), min_size=1, max_size=4))
def test_runs_of_few_words(texts):
    texts = [[b"%d" % x for x in t] for t in texts]
    assert periodic_runs.runs_of_texts(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_blocks(blocks):
    words = [b"%d" % x for block, times in blocks for x in block * times]
    runs = periodic_runs.runs_of_texts([words])[0]
    assert runs == plain_runs(words)
    assert periodic_runs.collapsed(words, runs).decode() == plain_collapsed([w.decode() for w in words], runs)


def test_long_text_of_one_word_and_of_a_long_block():
    assert periodic_runs.runs_of_texts([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    block = [b"%d" % i for i in range(50_000)]
    assert periodic_runs.runs_of_texts([[b"x"] + block * 5 + block[:7]]) == [[(1, 250_007, 50_000)]]
    assert periodic_runs.runs_of_texts([block * 3 + block[:-1]]) == [[]]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(map(str, rng.integers(0, 400, n)))
    rows = [(i, prose(int(rng.integers(0, 300)))) for i in range(60)]
    rows += [
        (60, None), (61, ""), (62, " \t\n"), (None, "a b " * 9), (63, "a b " * 8), (64, "la " * 7 + prose(20) + " la" * 6), (64, "la " * 7),
        (64, "la " * 7), (65, prose(40_000)), (66, "one\x0btwo\x0c" * 6), (67, "x y z " * 5 + "x y " * 5),
    ]
    return spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, runs long, `a.b` string")


def test_awkward_rows(docs):
    got = sorted(map(str, ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect())))
    want = []
    for doc_id, text, *_ in docs.collect():
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words) if len(words) < 2_000 else []
        want.append(str((doc_id, len(words), runs, plain_collapsed(words, runs))))
    assert got == sorted(want)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_query_plants_runs_and_reports_them(spark, docs, tmp_path):
    docs.filter("doc_id < 65 or doc_id is null or doc_id > 65").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    got = sorted(map(str, map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect())))
    want = []
    for doc_id, text, *_ in docs.collect():
        if doc_id == 65:
            continue
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        text_of_runs = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append(str((
            doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(text_of_runs.encode()).hexdigest(),
            hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest(),
        )))
    assert planted > 3 and got == sorted(want)
    assert queries.op11_periodic_runs(spark, str(tmp_path)).filter(F.col("collapsed_sha256").isNull()).count() == 0
