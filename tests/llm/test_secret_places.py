"""Linked parts of credentials against every pair in plain Python."""

from __future__ import annotations

import numpy as np

from peakloom.llm import secret_links
from peakloom.llm.secret_links import BASE, KINDS, NEEDS, PART


def linked(spans, reach):
    """Weak spans (kind, start, stop) whose needs are met by spans of the same scope that share no character with them."""
    breaks = [s for s in spans if s[0] == len(KINDS)]
    strong = [s for s in spans if s[0] < len(BASE)]
    scope = lambda s: sum(b[1] <= s[1] for b in breaks)
    clear = [s for s in spans if len(BASE) <= s[0] < len(KINDS) and all(t[2] <= s[1] or t[1] >= s[2] for t in strong)]
    out = set()
    for s in clear:
        others = {
            PART[KINDS[t[0]]] for t in strong + clear
            if scope(t) == scope(s) and (0 <= s[1] - t[2] <= reach or 0 <= t[1] - s[2] <= reach)
        }
        how, needed = NEEDS[KINDS[s[0]]]
        if (any if how == "any" else all)(x in others for x in needed):
            out.add(s)
    return out


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for text in range(60):
        for kind in range(len(KINDS) + 1):
            at = 0
            # spans of one kind never overlap
            for _ in range(int(rng.integers(0, 7))):
                at += int(rng.integers(0, 60))
                rows.append((bytes([text]), kind, at, at + int(rng.integers(3, 40))))
                at = rows[-1][3]
    df = spark.createDataFrame(rows, "_key binary, kind int, start long, stop long")
    for reach in (20, 200):
        found = {(bytes(r._key), r.kind, r.start, r.stop) for r in secret_links.link_parts(df, reach).collect()}
        expected = {(bytes([t]), *s) for t in range(60) for s in linked([r[1:] for r in rows if r[0] == bytes([t])], reach)}
        assert found == expected and found


def test_address_is_no_evidence_for_a_part_of_itself(spark):
    url = "https://en.example.org/wiki/Battle_of_Hastings_1066"
    secret = "Ab3dEf6hIj9lMn2pQr5tUv8x"
    rows = [(1, f"See {url} for more."), (2, f"login: joe {secret}"), (3, f"{secret} at https://api.example.org/v1"), (4, f"user: {secret}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans] for r in secret_links.scan(df).collect()}
    assert found == {1: [], 2: ["identifier", "secret"], 3: ["secret"], 4: []}
    assert {r.doc_id: r.text for r in secret_links.redact(df).collect()}[1] == rows[0][1]
