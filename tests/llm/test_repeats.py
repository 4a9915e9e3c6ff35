"""Repeated passages against plain Python: removed bytes, and groups with all their occurrences, on every route."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from peakloom.llm import queries, repeats

SCHEMA = "doc_id long, text string, key int, `a.b` string"


def words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(n))


def corpus(seed):
    """Passages that recur whole, cut, edited, next to different text, inside one text, and over more than one anchor."""
    rng = np.random.default_rng(seed)
    long, short, near = words(rng, 160), words(rng, 45), words(rng, 70)
    out = []
    for i in range(24):
        parts = [words(rng, int(rng.integers(0, 40)))]
        if i % 2:
            a = int(rng.integers(0, 500))
            parts.append(long[a : a + int(rng.integers(150, 700))])
        if i % 3 == 0:
            parts.append(short)
        if i % 4 == 0:
            edited = list(near)
            edited[int(rng.integers(0, len(near)))] = "é"
            parts.append("".join(edited))
        rng.shuffle(parts)
        out.append((i, " ".join(parts)))
    out += [(100, long + long), (101, "ab" * 400), (102, "x" * 700), (103, None), (104, ""), (105, words(rng, 5)), (106, short * 3)]
    out += [(None, long), (None, long), (107, long), (107, long), (108, "ü" * 300 + short)]
    return out


def plain_removal(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


ROUTES = [(150, 18_150), (2, 18_150), (1, 1), (3, 6)]


@pytest.mark.parametrize("per_slice,in_memory", ROUTES)
def test_removed_bytes(spark, monkeypatch, tmp_path, per_slice, in_memory):
    monkeypatch.setattr(repeats, "PER_SLICE", per_slice)
    monkeypatch.setattr(repeats, "IN_MEMORY", in_memory)
    rows = corpus(per_slice + in_memory)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, map(tuple, queries.op9_repeats(spark, str(tmp_path)).collect()))) == plain_removal(rows)


def plain_groups(rows):
    """Maximal repeats within stretches, tried for every common prefix, with every place where their string occurs."""
    texts = sorted({(i, (t or "").encode()) for i, t in rows}, key=str)
    by_anchor: dict[int, list[tuple[bytes, bool]]] = {}
    for _, t in texts:
        data = np.frombuffer(t, np.uint8)
        _, first, _, count, gram, _ = repeats.anchors(data, np.array([0, len(data)]))
        for a, n, g in zip(first.tolist(), count.tolist(), gram.tolist()):
            by_anchor.setdefault(g, []).append(t[a : a + n + 199])
    found = set()
    for stretches in by_anchor.values():
        suffixes = [(s[o:], s[o - 1] if o else None) for s in stretches for o in range(len(s) - 199)]
        for x in range(len(suffixes)):
            for y in range(x):
                a, b = suffixes[x][0], suffixes[y][0]
                if a[:200] == b[:200]:
                    n = repeats._common(a, b)
                    string = a[:n]
                    if string not in found:
                        left = [p for s, p in suffixes if s.startswith(string)]
                        if None in left or len(set(left)) > 1:
                            found.add(string)
    out = set()
    for string in found:
        for i, t in texts:
            at = t.find(string)
            while at >= 0:
                out.add((hashlib.md5(string).hexdigest(), len(string), i, at))
                at = t.find(string, at + 1)
    return out


@pytest.mark.parametrize("per_slice,in_memory", ROUTES)
def test_groups_hold_all_occurrences(spark, monkeypatch, per_slice, in_memory):
    monkeypatch.setattr(repeats, "PER_SLICE", per_slice)
    monkeypatch.setattr(repeats, "IN_MEMORY", in_memory)
    monkeypatch.setattr(repeats, "RANKS", 2)
    rng = np.random.default_rng(7)
    core = words(rng, 60)
    rows = [(i, words(rng, 12) + core[i % 7 * 5 : 330 - i % 5 * 9] + words(rng, 12)) for i in range(14)]
    rows += [(50, core), (50, core), (51, core), (52, core + core), (None, core[:250]), (53, None), (54, "ab" * 130)]
    got = repeats.repeat_groups(frame(spark, rows))
    listed = {(bytes(r.group).hex(), r.length, r.doc_id, r.start) for r in got.collect()}
    assert listed == plain_groups(rows)
    assert len({g for g, *_ in listed}) > 10
    assert repeats.repeat_groups(frame(spark, rows).limit(0)).count() == 0


def rare_core():
    """80 bytes that are the anchor of almost every string that holds them."""
    rng = np.random.default_rng(1)
    best = None
    for _ in range(40):
        data = np.frombuffer(words(rng, 8_000).encode(), np.uint8)
        _, _, _, _, gram, _ = repeats.anchors(data, np.array([0, len(data)]))
        _, first, place, _, _, _ = repeats.anchors(data, np.array([0, len(data)]))
        low = int(np.argmin(gram))
        at = int(first[low] + place[low])
        if best is None or gram[low] < best[0]:
            best = gram[low], bytes(data[at : at + 80]).decode()
    return best[1]


def test_very_many_stretches_of_one_anchor(spark):
    core, rng = rare_core(), np.random.default_rng(2)
    n = 20_000
    sides = [words(rng, 60) for _ in range(200)]
    # each text has the core between sides of its own; some come in pairs that agree for 200 bytes and more
    texts = [f"{sides[i % 200][i % 90 : i % 90 + 100]}{i:07d}{core}{i:07d}{sides[(i * 7) % 200][: 100 + i % 9]}" for i in range(n)]
    twins = [texts[i][20:-1] for i in range(0, n, 4_000)] + [texts[5][20:260] + "!"]
    rows = list(enumerate(texts + twins))
    df = frame(spark, rows)
    most = repeats._Corpus(df).unclear.agg({"distinct": "max"}).first()[0]
    assert most > repeats.IN_MEMORY
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in repeats.remove_repeats(df).collect())
    assert got == plain_removal(rows)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 1_500)
    rng = np.random.default_rng(9)
    base = words(rng, 900)
    rows = [(1, base), (2, words(rng, 30) + base[700:4_000] + words(rng, 200)), (3, "short"), (4, base[1_400:1_700])]
    data = np.frombuffer(base.encode(), np.uint8)
    whole = repeats.anchors(data, np.array([0, len(data)]))
    parts = [np.concatenate(x) for x in zip(*repeats._long_text(data))]
    assert all((a == b).all() for a, b in zip(whole, parts))
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    assert got == plain_removal(rows)
