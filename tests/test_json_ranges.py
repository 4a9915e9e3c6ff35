"""JSON documents cut at every possible byte, against the json module."""

import json

import numpy as np
import pytest

from peakloom.sources import json_ranges, libraries

TRICKY = [
    {"name": 'a "quoted" \\ name', "spectrum": "41:1 42:2"}, {"name": "brackets ]}[{ , inside", "spectrum": "41:1"}, {"name": "ends with \\", "spectrum": "1:2"},
    {"name": "\\\\\\\"", "spectrum": "1:2"}, {"name": "ünï \U0001f600", "spectrum": "3:4", "id": {"nested": [1, [2, {"x": "]"}]]}}, {"name": "", "spectrum": "1:1"},
    {"name": "long", "spectrum": "41:1 " * 40}, {"compound": "last", "spectrum": "9:9"},
]


def items(spark, path, block):
    return [r.text for r in json_ranges.json_items(spark, str(path), block).orderBy("split", "row").collect()]


@pytest.mark.parametrize("ascii_only,indent", [(True, None), (False, 1), (False, None)])
def test_cuts_at_every_size(ascii_only, indent):
    """Block states found one after the other, as the windows do, and items of all blocks together."""
    text = json.dumps(TRICKY, ensure_ascii=ascii_only, indent=indent).encode()
    whole = np.frombuffer(text, np.uint8)
    for block in [*range(1, 40), 97, 333, len(text), 5_000]:
        state, begins, ends = (0, 0, 0), [], []
        for at in range(0, len(text), block):
            data = whole[at : at + block]
            b, e, after = json_ranges._cuts(data, *state)
            quotes, trail = json_ranges._quotes(data, state[0])
            assert after[0] == trail
            begins += (b + at).tolist()
            ends += (e + at).tolist()
            state = after
        assert state == (0, 0, 0)
        assert [json.loads(text[a:b]) for a, b in zip(begins, ends)] == TRICKY


@pytest.mark.parametrize("block", [7, 64, 1_000, 1 << 20])
def test_lists_and_maps(spark, tmp_path, block):
    (tmp_path / "a.json").write_text(json.dumps(TRICKY, ensure_ascii=False, indent=2), encoding="utf-8")
    assert [json.loads(t) for t in items(spark, tmp_path / "a.json", block)] == TRICKY
    members = {f"name, {i}": {"ri": 400.5 + i} for i in range(30)}
    (tmp_path / "b.json").write_text(json.dumps(members))
    got = {}
    for t in items(spark, tmp_path / "b.json", block):
        got |= json.loads("{" + t + "}")
    assert got == members
    for text in ("[]", "[ ]", " [\n] ", "{}"):
        (tmp_path / "c.json").write_text(text)
        assert items(spark, tmp_path / "c.json", block) == []


def test_library_and_index_table_in_blocks(spark, tmp_path):
    entries = [{"name": f"Entry {i}", "casNumber": f"{i}-00-1", "spectrum": f"41:{i + 1} 42:2 43:3"} for i in range(300)] + TRICKY
    (tmp_path / "big.json").write_text(json.dumps(entries, separators=(",", ":")))
    (tmp_path / "one.json").write_text(json.dumps({"name": "Single", "spectrum": "41:1"}))
    whole = libraries.read_library_json(spark, str(tmp_path)).collect()
    cut = libraries.read_library_json(spark, str(tmp_path), block=500).collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut)) and len(cut) == 308
    places = libraries._json_with_places(spark, str(tmp_path / "big.json"), 500).orderBy("place").collect()
    assert [r.name for r in places] == [(e.get("compound") or e["name"]).lower().strip() for e in entries if e.get("compound") or e["name"]]
    assert len({r.place.split for r in places}) > 20
    table = {f"Name {i}": {"ri": 300.0 + i * 10, "cas": str(i)} for i in range(200)}
    (tmp_path / "ri.json").write_text(json.dumps(table))
    rows = {}
    for block in (1 << 20, 400):
        read = libraries.read_ri_table(spark, str(tmp_path / "ri.json"), block).orderBy("ord").collect()
        rows[block] = [(r.name, r.ri, r.n, r.cas, list(r.all_ri)) for r in read]
    assert rows[400] == rows[1 << 20] and len(rows[400]) == 189
