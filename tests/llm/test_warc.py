"""Packages against zipfile and plain grouping: round trip, ZIP64 records, ranges, broken files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import struct
import zipfile
import zlib

import pytest

from peakloom.llm import warc, zip_archives
from peakloom.llm.zip_archives import ZipReader

PAGES = "page_id long, url string, html string, _payload string, `x.y` string"


def pages():
    big, other = "<p>" + "long text " * 200 + "</p>", "ä" * 500
    rows = [(i, f"http://h/{i}", big) for i in range(40)]
    rows += [(100, "http://a/b c\r\nInjected: yes", other), (99, None, other), (98, "", "x" * 999), (97, "u", "x" * 999), (96, "u", None), (95, "u", "")]
    rows += [(None, "n", big), (None, "n", "only without ids " * 100), (None, "n", "only without ids " * 100)]
    rows += [(39, "again", big), (39, "again", big), (3, "u", other + "!"), (3, "u", other + "?"), (500, "long", "z " * 3_000_000)]
    return rows


def expected(rows):
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html or ""] = max(i, top.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        leader = top.get(html or "")
        again = len(data) >= 1000 and leader is not None and (i is None or i < leader)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", leader if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("package_bytes,range_bytes", [(1 << 28, 1 << 23), (500, 100), (1 << 28, 1)])
def test_round_trip(spark, package_bytes, range_bytes):
    rows = pages()
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], PAGES).repartition(3)
    archives = warc.write_packages(df, package_bytes=package_bytes)
    read = warc.read_packages(archives, range_bytes=range_bytes)
    got = [(r.page and int(r.page), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in read.collect()]
    assert sorted(map(str, got)) == expected(rows)
    bodies = {(r.page, bytes(r.payload)) for r in read.filter("payload is not null").collect()}
    assert bodies <= {(None if i is None else str(i), (h or "").encode()) for i, _, h in rows}
    assert read.filter("record_type = 'revisit' and payload is not null").count() == 0
    assert archives.count() > 20 or package_bytes > 500
    urls = {r.url for r in read.filter("page = '100'").collect()}
    assert urls == {"http://a/b%20c%0D%0AInjected:%20yes"}


def test_empty_table_and_no_archives(spark):
    none = spark.createDataFrame([], PAGES)
    archives = warc.write_packages(none)
    assert archives.count() == 0 and warc.read_packages(archives).count() == 0
    assert warc.read_packages(spark.createDataFrame([(None,)], "archive string")).count() == 0


def record(page, payload, kind="response"):
    return warc.warc_record(str(page), f"http://h/{page}", payload, None)


def test_foreign_packages(spark, tmp_path):
    """A member without an index, an uncompressed WARC, a comment that looks like an end record, other members, plain gzip."""
    path = str(tmp_path / "a.wacz")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("archive/one.warc", record(1, b"one") + record(2, b"two" * 10))
        z.writestr("archive/two.warc.gz", gzip.compress(record(3, b"three")) + gzip.compress(record(4, b"")) + gzip.compress(record(5, b"x") + record(6, b"y")))
        z.writestr("indexes/index.cdx", 'h 2000 {"offset": 0, "length": 5, "filename": "two.warc.gz"}\n\nno brace\n')
        z.comment = b"note PK\x05\x06 and more"
    found = warc.read_packages(spark.createDataFrame([(path,)], "archive string")).collect()
    assert sorted((r.page, bytes(r.payload)) for r in found) == [("1", b"one"), ("2", b"two" * 10), ("3", b"three"), ("4", b""), ("5", b"x"), ("6", b"y")]


def test_members_equal_zipfile(tmp_path):
    path = str(tmp_path / "b.zip")
    with zipfile.ZipFile(path, "w") as z:
        for i in range(300):
            z.writestr(f"ü/{i}.txt", b"x" * i)
    with ZipReader(path) as mine, zipfile.ZipFile(path) as theirs:
        assert [(m.name, m.size, m.header) for m in mine.members()] == [(i.filename, i.file_size, i.header_offset) for i in theirs.infolist()]
        for m in mine.members()[::37]:
            assert mine.read(mine.data_place(m), m.size) == theirs.read(m.name)


def wide_zip(data: bytes) -> bytes:
    """A ZIP file whose every 32-bit field is full, with the values in the 64-bit records; zipfile writes these only for
    files beyond 4 GB."""
    full16, full32 = 0xFFFF, 0xFFFFFFFF
    name = b"archive/wide.warc"
    front = b"#" * 10
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, full32, full32, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    header = len(front)
    extra = struct.pack("<HHB", 0x9999, 1, 7) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), header)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, full32, full32, len(name), len(extra), 0, 0, 0, 0, full32) + name + extra
    place = len(front) + len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), place)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, place + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", full16, full16, full16, full16, full32, full32, 0)
    return front + local + data + entry + end64 + locator + end


def test_zip64_directories(spark, tmp_path):
    path = tmp_path / "wide.zip"
    path.write_bytes(wide_zip(record(9, b"nine")))
    with ZipReader(str(path)) as z:
        (member,) = z.members()
        assert member.header == 10 and z.read(z.data_place(member), member.size) == record(9, b"nine")
    assert [r.page for r in warc.read_packages(spark.createDataFrame([(str(path),)], "archive string")).collect()] == ["9"]


def test_broken_files(tmp_path):
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("archive/a.warc", record(1, b"one"))
    path = tmp_path / "c.zip"
    path.write_bytes(good.getvalue()[:-30])
    with ZipReader(str(path)) as z, pytest.raises(ValueError, match="end of central directory"):
        z.members()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", record(1, b"one"))
    with pytest.raises(ValueError, match="compressed"):
        list(warc.ranges_of(str(path)))
    wrong = record(1, b"one").replace(base64.b32encode(hashlib.sha1(b"one").digest()), base64.b32encode(hashlib.sha1(b"two").digest()))
    with pytest.raises(ValueError, match="digest"):
        [warc.described(f, b) for f, b in warc.parse_records(wrong, False)]


def test_what_a_lost_attempt_left_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "packages")
    os.mkdir(folder)
    warc.PackageWriter(f"{folder}/pages-lost.wacz").close()
    (tmp_path / "packages" / "pages-half.wacz").write_bytes(b"PK")
    archives = warc.write_packages(spark.createDataFrame([(1, "u", "one", "a", "b")], PAGES), folder)
    assert warc.read_packages(archives).count() == 1
    assert zip_archives.open_store(archives.first()[0])[1].startswith(folder)


def test_a_range_is_unpacked_in_time_linear_in_its_bytes(monkeypatch):
    """What is handed to the openers grows with the range, not with its members times its bytes."""
    records = [os.urandom(1500) for _ in range(300)] + [b"", os.urandom(50_000), b"a" * 500_000]
    data = b"".join(gzip.compress(r) for r in records)
    given, make = [], zlib.decompressobj

    class Opener:
        def __init__(self, *args):
            self.inner = make(*args)

        def decompress(self, piece):
            given.append(len(piece))
            return self.inner.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(zlib, "decompressobj", Opener)
    assert list(warc._unpacked(data)) == records
    assert sum(given) < len(data) + len(records) * 8192


@pytest.mark.parametrize("size", [1, 7, 64])
def test_members_end_anywhere_in_a_piece(monkeypatch, size):
    monkeypatch.setattr(warc, "PIECE_BYTES", size)
    records = [b"x" * n for n in (0, 1, 5, 300, 2)]
    assert list(warc._unpacked(b"".join(gzip.compress(r) for r in records))) == records
    # a member that is cut short gives what is there
    assert list(warc._unpacked(gzip.compress(b"whole") + gzip.compress(os.urandom(900))[:500]))[0] == b"whole"
