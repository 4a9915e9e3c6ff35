"""The filter audit against filters applied one after the other, order by order."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from peakloom.llm import filter_audit

DOCS = "doc_id long, text string, source string, mask string, n string, `a.b` string"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):
        n, kinds = int(rng.integers(150, 260)), int(rng.integers(60, 260))
        words = [f"w{x}" for x in rng.integers(0, kinds, n)]
        if rng.random() < 0.4:
            words[3] = "C#"
        if rng.random() < 0.4:
            words[:30] = [w.upper() for w in words[:30]]
        texts.append(" ".join(words))
    rows = [(i, texts[int(rng.integers(0, 40))], ["a", "b", None][int(rng.integers(0, 3))]) for i in range(120)]
    rows += [
        (200, None, "a"), (201, "", "a"), (202, " ", None), (None, texts[0], "b"), (None, texts[0], "b"), (5, texts[1], ""), (5, texts[1], ""),
        (5, "Ä \U0001f600 $", "c"), (300, "word " * 30_000 + "X" * 5_000, "long"), (-1, texts[2], "b"),
    ]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 120, 2)]
    labels += [(0, 1, None), (0, None, 1), (None, 1, 1), (200, None, None), (999, 1, 1)]
    return rows, labels


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    lowest = {}
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))
    states = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        states.append((part or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > lowest[text],
        }, i in good, i in toxic))
    out, removed_by = {}, {}
    for part in {s[0] for s in states}:
        own = [s for s in states if s[0] == part]
        for order in permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone = [s for s in alive if s[1][f]]
                alive = [s for s in alive if not s[1][f]]
                redundant = sum(s[1][f] for s in own) - len(gone)
                unique = sum(s[1][f] and sum(s[1].values()) == 1 for s in own)
                out[part, "".join(order), step] = [len(alive), len(gone), redundant, unique, sum(s[2] for s in gone), sum(s[3] for s in gone)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_filters_one_by_one(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == plain(rows, labels)
    assert {k[0] for k in got} == {"a", "b", "", "c", "long"}


def test_empty_tables(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS), spark.createDataFrame(labels, LABELS)
    assert filter_audit.audit(docs.limit(0), known).count() == 0
    without = filter_audit.audit(docs, known.limit(0))
    assert without.count() == 5 * 600 and without.filter("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("n", [1, 2**32, 2**62])
def test_fields_do_not_run_into_each_other(n):
    states = [(m, bool(m & 1), bool(m & 2), n // 32 if n > 32 else n) for m in range(32)]
    each = states[0][3]
    audit = filter_audit.audit_of("p", states).to_pylist()
    small = filter_audit.audit_of("p", [(m, g, t, 1) for m, g, t, _ in states]).to_pylist()
    for a, b in zip(audit, small):
        for c in filter_audit.OUTCOMES:
            assert a[c] == b[c] * each
