"""Packing against the tokenizer file's own library with its default settings, and the invariants of a packing."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest

from peakloom.llm import packing, queries

END = "<|endoftext|>"
TEXTS = [
    f"a b {END} c", END, f"{END}{END}", f"x{END[:-1]} {END[1:]}", f"{END} " * 30, "<|endoftext", f" {END}\n{END}\t", "z" * 5_000 + END + " " * 3_000,
    None, "", "ä\U0001f600 \x00 \r\n", "word " * 9_000, "one two three " * 2_047, "q" * 40_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    alphabet = list("ab \n\té0'<|>") + [END, "endoftext", "  ", "don't"]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "".join(rng.choice(alphabet, int(rng.integers(0, 60))))) for i in range(150)]
    rows += [(None, "no id"), (None, "no id"), (7, "again"), (7, "again"), (8, "w " * 5_000), (8, "w " * 5_000)]
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, block int, length string, `a.b` string").repartition(5)


def library_ids(path, text, as_text=False):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = as_text
    return own.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("as_text", [False, True])
def test_ids_are_those_of_the_library(docs, as_text):
    path = queries.vocabulary("byte_bpe_50k.json")
    pieces = packing.pack(docs, path, queries.token_pattern(), added_as_text=as_text).collect()
    got: dict = {}
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        got.setdefault(p.doc_id, []).append((p.start, p.piece, p.ids))
    rows: dict = {}
    for r in docs.collect():
        rows.setdefault(r.doc_id, []).append(r.text)
    for doc_id, texts in rows.items():
        want = [i for t in texts for i in library_ids(path, t, as_text)]
        if len(texts) == 1:
            ids = [i for _, _, part in sorted(got[doc_id]) for i in part]
            assert ids == want
            assert [(s, n) for s, n, _ in sorted(got[doc_id])] == [(s, k) for k, (s, _, _) in enumerate(sorted(got[doc_id]))]
        else:
            assert sorted(i for _, _, part in got[doc_id] for i in part) == sorted(want)


def test_every_piece_has_its_place(docs):
    pieces = packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"), queries.token_pattern()).toPandas()
    for number, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
        assert number >= 0 or (len(g) == 1 and g.length.iloc[0] == 2048)
    assert pieces.sequence_id.nunique() <= -(-pieces.length.sum() // 2048) + 2
    for _, g in pieces[pieces.doc_id < 7].groupby("doc_id"):
        assert len(g) == -(-g.length.sum() // 2048) and (g.length[g.piece > 0] == 2048).all()


def test_added_tokens_that_look_around_are_refused():
    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        described = json.load(file)
    assert packing.added_tokens(described) == {END: 50256}
    described["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="beside"):
        packing.added_tokens(described)
    assert packing.added_tokens({}) == {}


def test_longer_added_token_goes_first():
    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokens = packing.ranks_of(json.load(file))
    own = packing.Tokenizer(tokens, queries.token_pattern(), {"<a>": 7, "<a><b>": 8})
    assert [i for i in own.encode("<a><b><a>x") if i in (7, 8)] == [8, 7]
