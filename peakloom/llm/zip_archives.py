"""Reading members of ZIP files in place: directories are parsed, stored members located, and byte ranges read.

Nothing is extracted. Sizes and places come from the central directory, with the 64-bit records of ZIP64 where a 32-bit
field is full. Files are opened through ``pyarrow.fs`` (local, HDFS and object stores by their URI), so a task reads only
the ranges it needs.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow.fs as pafs

FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF
END, END_64, LOCATOR_64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED = 0


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class ZipReader:
    """Members of one ZIP file by its central directory."""

    def __init__(self, uri: str) -> None:
        system, path = open_store(uri)
        self.uri, self.file = uri, system.open_input_file(path)
        self.size = self.file.size()

    def __enter__(self) -> ZipReader:
        return self

    def __exit__(self, *error: object) -> None:
        self.file.close()

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"{self.uri}: {length} bytes at {start} are not there")
        return data

    def directory(self) -> tuple[int, int, int]:
        """Number of entries, length and place of the central directory."""
        tail_at = max(0, self.size - (22 + FULL_16 + 20))
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(END)
        # the comment of the archive may hold the same four bytes: the real record's comment ends the file
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError(f"{self.uri}: no end of central directory")
        disk, first_disk, _, entries, length, place = struct.unpack_from("<HHHHII", tail, end + 4)
        if FULL_16 in (disk, first_disk, entries) or FULL_32 in (length, place):
            locator = self.read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
            if locator[:4] == LOCATOR_64:
                record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != END_64:
                    raise ValueError(f"{self.uri}: no 64-bit end of central directory where its locator points")
                disk, first_disk = struct.unpack_from("<II", record, 16)
                entries, length, place = struct.unpack_from("<QQQ", record, 32)
        if disk or first_disk:
            raise ValueError(f"{self.uri}: archives in several parts cannot be read")
        return entries, length, place

    def members(self) -> list[Member]:
        entries, length, place = self.directory()
        data, at, out = self.read(place, length), 0, []
        for _ in range(entries):
            if data[at : at + 4] != ENTRY:
                raise ValueError(f"{self.uri}: broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            stored_size, size = struct.unpack_from("<II", data, at + 20)
            names, extras, comments = struct.unpack_from("<HHH", data, at + 28)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + names : at + 46 + names + extras]
            if FULL_32 in (size, stored_size, header):
                size, stored_size, header = _wide(extra, size, stored_size, header)
            out.append(Member(name, method, size, stored_size, header))
            at += 46 + names + extras + comments
        return out

    def data_place(self, member: Member) -> int:
        """Where the bytes of a stored member begin; compressed members have no ranges to read."""
        if member.method != STORED:
            raise ValueError(f"{self.uri}: {member.name} is compressed, only stored members can be read in ranges")
        local = self.read(member.header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"{self.uri}: no member at {member.header}")
        return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def _wide(extra: bytes, size: int, stored_size: int, header: int) -> tuple[int, int, int]:
    """The 64-bit values of the extra field 1, which holds only those whose 32-bit field is full, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{min(length // 8, 3)}Q", extra, at + 4))
            return tuple(next(values) if v == FULL_32 else v for v in (size, stored_size, header))  # type: ignore[return-value]
        at += 4 + length
    return size, stored_size, header
