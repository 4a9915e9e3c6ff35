"""NumPy over the bytes of many texts at once, for use inside tasks.

Texts of an Arrow batch lie behind one another in one buffer. Runs of bytes are hashed with prefix sums of
``value[byte] * R**position`` modulo 2^64, so the hash of any run costs two look-ups whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

R = np.uint64(0x9E3779B97F4A7C15)
R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes worked on at a time (a longer text is one piece); temporaries take about 60 times this.
PIECE = 1 << 20

_spread = np.random.default_rng(1)
BYTE_VALUE = _spread.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, which: str = "up") -> np.ndarray:
    """R**0 .. R**(n-1), or of its inverse; kept per worker process."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.full(max(n, PIECE + 4096), R if which == "up" else R_INVERSE, np.uint64)
        base[0] = 1
        have = _powers[which] = np.multiply.accumulate(base)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers, so that low and high bits depend on all of the input."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data)), out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((sums[stop] - sums[start]) * powers(len(sums), "down")[start])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``PIECE`` bytes of text each: rows, bytes, offsets."""
    data, offsets = text_buffer(batch.column(text))
    row = 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(row, last - row), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of maximal runs of equal non-zero kinds that do not cross the offsets."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(edge)
    stops = np.append(starts[1:], n)
    real = kind[starts] != 0
    return starts[real], stops[real]


_space = np.ones(256, np.uint8)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
NOT_SPACE = _space


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of non-white-space) and the first word of each text: (hashes, bounds)."""
    starts, stops = runs(NOT_SPACE[data], offsets)
    hashes = run_hashes(prefix_sums(data), starts, stops)
    return hashes, np.searchsorted(starts, offsets)
