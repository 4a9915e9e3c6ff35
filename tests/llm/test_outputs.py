"""The operators return texts and ids, not digests alone."""

from __future__ import annotations

import zlib

import numpy as np
from tests.llm.test_operators import BASE, NEAR, prose

from peakloom.llm import line_rules, packing, queries, repeats


def test_lines_above_the_limit_leave_the_text(spark):
    rows = [(i, f"\nthe very  same line\n\n{prose(i, 30)}\nthe very same line", "h") for i in range(30)] + [(98, None, "h"), (99, "", "h")]
    rows.append(rows[3])
    found = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i].text == f"\n\n{prose(i, 30)}" and found[i].n_removed_words == 8 for i in range(30))
    assert found[98].text is None and found[99].text == ""


def test_left_bytes_are_returned(spark):
    own = "something of its own " * 3
    rows = [(1, BASE), (2, own + BASE), (3, "short"), (4, None)]
    found = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: b"", 2: own.encode(), 3: b"short", 4: b""}


def test_pieces_carry_their_ids(spark):
    import tiktoken
    import json

    path, pattern = queries.vocabulary("byte_bpe_50k.json"), queries.token_pattern()
    with open(path, encoding="utf-8") as file:
        tokens = packing.ranks_of(json.load(file))
    plain = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = {1: NEAR, 2: prose(9, 4000), 3: ""}
    pieces = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, pattern).collect()
    for i, text in texts.items():
        mine = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == [*plain.encode_ordinary(text), 0]
        assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in mine)
