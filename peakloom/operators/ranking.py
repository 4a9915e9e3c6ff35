"""Ranked hits of whole queries (the task of M10, M11, M16 and W10).

A task holds some queries and reads the stored library block by block, so all hits of a query meet in the task that finds
them and are ranked there. They leave it as they are returned: no hit is shuffled or sorted again, however many there are.
Factors are computed in doubles by the same steps as expressions in Spark would take.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq

from peakloom.operators import ionmatch

#: Pairs of queries and entries that one task may keep as hits at once.
PAIRS = 24_000_000
#: Rows of one batch that leaves a task, and of one that is read.
ROWS, READ_ROWS = 65_536, 4_096


def scaled(score: np.ndarray) -> np.ndarray:
    """Match factor 0-999, truncated."""
    return np.clip(np.trunc(score * 999), 0, 999)


def cosine(dot: np.ndarray, lib_sq: np.ndarray, query_sq: float) -> np.ndarray:
    """M1."""
    return dot / np.sqrt(lib_sq * query_sq)


def forward(dot: np.ndarray, lib_sq: np.ndarray, query_sq: float, matched_query: np.ndarray, n_query: int) -> np.ndarray:
    """M2."""
    return cosine(dot, lib_sq, query_sq) * 0.8 + matched_query / n_query * 0.2


def reverse(dot: np.ndarray, lib_sq: np.ndarray, matched: np.ndarray, n_lib: np.ndarray) -> np.ndarray:
    """M3."""
    return dot / np.sqrt(lib_sq * lib_sq) * 0.7 + matched / n_lib * 0.3


def hybrid(forward_factor: np.ndarray, reverse_factor: np.ndarray, weight: float = 0.6) -> np.ndarray:
    """M4, on the two integer factors."""
    return forward_factor / 999.0 * weight + reverse_factor / 999.0 * (1 - weight)


def ri_penalty(ri_library: np.ndarray, ri_expected: float, tolerance: float) -> np.ndarray:
    """M7, with NaN for an unknown index."""
    with np.errstate(invalid="ignore"):
        d, t = np.abs(ri_library - ri_expected), tolerance
        steps = [1.0, 1.0 - 0.5 * (d - t) / t, 0.5 - 0.4 * (d - t * 2) / (t * 2)]
        unknown = np.isnan(ri_library) | np.isnan(ri_expected)
        return np.select([unknown | (d <= t), d <= t * 2, d <= t * 4], steps, 0.1)


@dataclass
class Query:
    n: int
    square: float
    #: NaN if unknown.
    index: float


@dataclass
class Entries:
    """Attributes of library entries; ``index`` is NaN if unknown, ``factor`` that of the class."""

    n: np.ndarray
    square: np.ndarray
    index: np.ndarray
    factor: np.ndarray

    def at(self, some: np.ndarray) -> Entries:
        return Entries(self.n[some], self.square[some], self.index[some], self.factor[some])


@dataclass
class Rule:
    """How the hits of a query are scored and ranked: whole numbers per hit that are kept, and the place of each hit.

    ``limit`` is the score of ``ionmatch`` that a hit reaches at least.
    """

    mode: str
    limit: float
    min_match: int
    k: int | None = None
    leaders: ionmatch.Leaders | None = None
    both: bool = True
    counts: bool = True

    def score(self, query: Query, entries: Entries, sums: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Values of each pair, the first of which is at least ``min_match`` for a hit."""
        raise NotImplementedError

    def columns(self, query: Query, entries: Entries, values: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def order(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        """Rows by falling rank; equal ones stay in their order."""
        raise NotImplementedError

    def promoted(self, order: np.ndarray, columns: dict[str, np.ndarray], entry_index: np.ndarray, query_index: np.ndarray) -> np.ndarray:
        return order


def _factors(mode: str, query: Query, entries: Entries, sums: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    dot, matched, _, matched_back = sums
    fwd = scaled(forward(dot, entries.square, query.square, matched_back, query.n)) if mode != "reverse" else None
    rev = scaled(reverse(dot, entries.square, matched, entries.n)) if mode != "forward" else None
    return fwd, rev


def _falling(values: np.ndarray) -> np.ndarray:
    """Stable order of falling values; small whole numbers are sorted by digits."""
    if len(values) and values.dtype.kind == "i" and 0 <= values.min() and values.max() < 2**15:
        values = values.astype(np.int16)
    return np.argsort(-values, kind="stable")


@dataclass
class Indexed(Rule):
    """Factors of index and class after the threshold, and promotion."""

    ri_tolerance: float = 50.0
    promote: bool = True

    def score(self, query, entries, sums):
        if self.mode == "cosine":
            return (scaled(cosine(sums[0], entries.square, query.square)).astype(np.int16),)
        fwd, rev = _factors(self.mode, query, entries, sums)
        raw = {"forward": lambda: fwd, "reverse": lambda: rev, "hybrid": lambda: scaled(hybrid(fwd, rev))}[self.mode]()
        return (raw.astype(np.int16),)

    def columns(self, query, entries, values):
        penalty = ri_penalty(entries.index, query.index, self.ri_tolerance)
        effective = np.trunc(values[0] * penalty * entries.factor).astype(np.int32)
        return {"match_factor": values[0].astype(np.int32), "effective_match": effective, "ri_penalty": penalty}

    def order(self, columns):
        return _falling(columns["effective_match"])

    def promoted(self, order, columns, entry_index, query_index):
        """The best index-backed hit goes first when the leader has no index and is not 80 points better."""
        backed = ~np.isnan(entry_index[order])
        if not self.promote or not backed.any() or backed[0]:
            return order
        place = int(np.argmax(backed))
        row, factor = order[place], columns["match_factor"]
        if np.isnan(query_index[row]) or factor[row] < factor[order[0]] - 80 or columns["ri_penalty"][row] < 0.9:
            return order
        return np.concatenate([[row], order[:place], order[place + 1 :]])


@dataclass
class Fast(Rule):
    """The hybrid score unrounded, index penalty and flat class factors (NaN for none) before the threshold."""

    ri_tolerance: float = 50.0

    def score(self, query, entries, sums):
        if self.mode == "hybrid":
            fwd, rev = _factors(self.mode, query, entries, sums)
            score = fwd * 0.6 + rev * 0.4
        else:
            score = Indexed.score(self, query, entries, sums)[0].astype(np.float64)
        if not np.isnan(query.index):
            penalty = ri_penalty(entries.index, query.index, self.ri_tolerance)
            score = np.where(np.isnan(entries.index), score, np.floor(score * penalty))
        return (np.where(np.isnan(entries.factor), score, np.floor(score * entries.factor)),)

    def columns(self, query, entries, values):
        whole = np.floor(values[0]).astype(np.int32)
        penalty = ri_penalty(entries.index, query.index, self.ri_tolerance)
        return {"match_factor": whole, "effective_match": whole, "ri_penalty": penalty, "score": values[0]}

    def order(self, columns):
        return _falling(columns["score"])


@dataclass
class Mutual(Rule):
    """M5, M6: both directions; a weak one caps the combined factor at 500."""

    require_both: bool = True

    def score(self, query, entries, sums):
        f = scaled(cosine(sums[0], entries.square, query.square)).astype(np.int16)
        r = scaled(cosine(sums[2], entries.square, query.square)).astype(np.int16)
        if not self.require_both:
            return np.maximum(f, r), f, r
        mean = (f + r) // 2
        return np.where((f < 400) | (r < 400), np.minimum(mean, 500), mean), f, r

    def columns(self, query, entries, values):
        return dict(zip(("match_factor", "match_forward", "match_reverse"), (x.astype(np.int32) for x in values)))

    def order(self, columns):
        return _falling(columns["match_factor"])


def open_file(uri: str) -> pa.NativeFile:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + unquote(uri.removeprefix("file:")).lstrip("/"))
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def blocks(files: list[str], columns: list[str], block_ions: int) -> Iterator[pa.Table]:
    """The stored library in tables of about as many ions, in its stored order."""
    held, size = [], 0
    for file in files:
        with open_file(file) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(min(READ_ROWS, block_ions), columns=columns, use_threads=False):
                ions = size + np.cumsum(pc.fill_null(pc.list_value_length(batch.column("peaks")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                start = 0
                for stop in (np.flatnonzero(np.diff(ions // block_ions, prepend=size // block_ions)) + 1).tolist():
                    yield pa.Table.from_batches([*held, batch.slice(start, stop - start)])
                    held, start = [], stop
                held = [*held, batch.slice(start)] if start < len(batch) else held
                size = int(ions[-1]) if len(ions) else size
    if held:
        yield pa.Table.from_batches(held)


def _portions(queries: pa.Table, most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Queries in tables of about ``most`` rows, all rows of one id together, with the first row of each id."""
    ids = queries.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    queries, ids = queries.take(order), ids[order]
    firsts = np.flatnonzero(np.diff(ids, prepend=-1))
    # a portion ends with the id that fills it
    for some in np.split(firsts, np.flatnonzero(np.diff(firsts // most)) + 1):
        after = np.searchsorted(firsts, some[-1], "right")
        stop = firsts[after] if after < len(firsts) else len(ids)
        yield queries.slice(some[0], stop - some[0]), some - some[0]


def ranker(
    files: list[str], n_lib: int, schema: pa.Schema, rule: Rule, tolerance: float, by_base_peak: bool, block_ions: int,
    carried: list[str],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task over queries: a row per hit with the number of the entry, its values and its rank."""
    wanted = ["entry", "load_seq", "peaks", "n_lib", "lib_sq", "ri_exp", "factor", *(["base_peak_mz"] if by_base_peak else [])]
    doubles = lambda column: column.to_numpy().astype(np.float64)

    def hits(queries: pa.Table, firsts: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        index = ionmatch.indices(queries.column("ri_expected"))
        asked = [Query(int(n), float(square), float(x)) for n, square, x in zip(queries.column("n_query").to_numpy(), queries.column("query_sq").to_numpy(), index)]
        found, parts, numbers, places, seen = defaultdict(list), [], [], [], 0
        position = np.int32 if n_lib < 2**31 else np.int64
        for block in blocks(files, wanted, block_ions):
            entries = Entries(doubles(block.column("n_lib")), doubles(block.column("lib_sq")), ionmatch.indices(block.column("ri_exp").cast(pa.float64())), doubles(block.column("factor")))
            for q, rows, sums in ionmatch.pairs(
                block, queries, rule.mode, rule.limit, tolerance, rule.both, by_base_peak, rule.leaders, rule.counts
            ):
                values = rule.score(asked[q], entries.at(rows), sums)
                reached = values[0] >= rule.min_match
                if reached.any():
                    found[q].append(((rows[reached] + seen).astype(position), *(x[reached] for x in values)))
            parts.append(entries)
            numbers.append(block.column("entry").to_numpy())
            places.extend(block.column("load_seq").chunks)
            seen += len(block)
        if not found:
            return
        numbers = np.concatenate(numbers)
        library = Entries(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("n", "square", "index", "factor")))
        # the library is stored in load order; if it were read in another one, ties would be put right here
        place = pc.rank(pa.chunked_array(places), tiebreaker="dense").to_numpy()
        sorted_already = bool((np.diff(place.astype(np.int64)) >= 0).all())
        for first, stop in zip(firsts.tolist(), [*firsts[1:].tolist(), len(asked)]):
            mine = [(q, [np.concatenate(x) for x in zip(*found.pop(q))]) for q in range(first, stop) if q in found]
            if not mine:
                continue
            at = np.concatenate([x[0] for _, x in mine])
            rows = [rule.columns(asked[q], library.at(x[0]), tuple(x[1:])) for q, x in mine]
            columns = {c: np.concatenate([r[c] for r in rows]) for c in rows[0]}
            query = np.repeat([q for q, _ in mine], [len(x[0]) for _, x in mine])
            if not sorted_already or len(mine) > 1:
                earlier = np.argsort(place[at], kind="stable")
                at, query, columns = at[earlier], query[earlier], {c: x[earlier] for c, x in columns.items()}
            order = rule.promoted(rule.order(columns), columns, library.index[at], index[query])[: rule.k]
            yield {"query": query[order], "entry": numbers[at[order]], "rank": np.arange(1, len(order) + 1, dtype=np.int32), **{c: x[order] for c, x in columns.items()}}

    def rows(queries: pa.Table, found: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
        query = columns.pop("query")
        for start in range(0, len(query), ROWS):
            some = slice(start, start + ROWS)
            arrays = {c: pa.array(x[some]) for c, x in columns.items()} | {c: queries.column(c).take(query[some]).combine_chunks() for c in ("query_id", *carried)}
            yield pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        kept = n_lib if rule.leaders is None else min(n_lib, 64 * rule.leaders.k)
        for queries, firsts in _portions(table, max(1, PAIRS // max(1, kept))):
            held, size = [], 0
            for found in hits(queries, firsts):
                held.append(found)
                size += len(found["query"])
                if size >= ROWS:
                    yield from rows(queries, held)
                    held, size = [], 0
            if held:
                yield from rows(queries, held)

    return run
