"""Ion matching inside one block of library spectra and one block of query spectra (the task of J5).

Library ions are indexed by m/z, but only those that a hit needs: sorted by falling intensity, the ions from some rank on
cannot reach the wanted score even if a query matched all of them, so a hit must share one of the ions before it. Pairs
found through these ions are scored exactly, whatever the m/z: each ion takes the nearest ion of the other spectrum, the
first one in its order if two are equally near. Where the ions of two blocks lie at few distinct m/z, as whole ones do, all
sums come from products of tables over these m/z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ions and (entry, query ion) cells that are worked on together.
CELLS = 1_000_000
#: Distinct m/z of two blocks up to which their spectra are laid out as tables over them.
FEW_PLACES = 512
#: Queries below which the ions of single entries are looked up pair by pair.
FEW_QUERIES = 16
SLACK = 1e-6


def best_score(
    mode: str, dot: np.ndarray, dot_back: np.ndarray, matched: np.ndarray, matched_back: np.ndarray,
    n_lib: np.ndarray, n_query: int, lib_sq: np.ndarray, query_sq: float,
) -> np.ndarray:
    """The score of a mode before truncation to whole numbers, so never less than the score. It rises with dot, dot_back,
    matched and matched_back: with bounds in their place it is a bound."""
    norm = np.sqrt(lib_sq * query_sq)
    cosine, back = np.minimum(1, dot / norm), np.minimum(1, dot_back / norm)
    forward = np.minimum(1, 0.8 * dot / norm + 0.2 * matched_back / n_query)
    reverse = np.minimum(1, 0.7 * dot / lib_sq + 0.3 * matched / n_lib)
    return 999 * {
        "cosine": lambda: cosine, "forward": lambda: forward, "reverse": lambda: reverse,
        "hybrid": lambda: 0.6 * forward + 0.4 * reverse, "mean": lambda: (cosine + back) / 2, "either": lambda: np.maximum(cosine, back),
    }[mode]()


@dataclass
class Spectra:
    """Ions of several spectra, each spectrum's by m/z and, where equal, by place."""

    sizes: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    mz: np.ndarray
    intensity: np.ndarray
    place: np.ndarray
    #: Position of the first ion with the same m/z.
    first: np.ndarray
    square: np.ndarray
    #: All ions have an m/z.
    complete: bool

    @classmethod
    def read(cls, peaks: pa.ChunkedArray) -> Spectra:
        lists = peaks.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        mz = flat.field("mz").to_numpy(zero_copy_only=False).astype(np.float64)
        intensity = np.nan_to_num(flat.field("intensity").to_numpy(zero_copy_only=False).astype(np.float64))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(mz)) - (np.cumsum(sizes) - sizes)[owner]
        # an ion without m/z meets none
        order = np.lexsort((place, mz, owner))
        complete = not np.isnan(mz).any()
        order = order[~np.isnan(mz[order])]
        owner = owner[order]
        sizes = np.bincount(owner, minlength=len(sizes))
        starts = np.cumsum(sizes) - sizes
        mz, intensity, place = mz[order], intensity[order], place[order]
        new = np.ones(len(mz), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (mz[1:] != mz[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(mz)), 0)) if len(mz) else place
        square = np.bincount(owner, intensity**2, len(sizes))
        return cls(sizes, starts, owner, mz, intensity, place, first, square, complete)

    def reuse(self, tolerance: float) -> np.ndarray:
        """Per spectrum, the most ions that can take the same ion of another spectrum: those in twice the tolerance."""
        out = np.ones(len(self.sizes))
        for step in range(1, int(self.sizes.max(initial=0))):
            close = (self.owner[step:] == self.owner[:-step]) & (self.mz[step:] - self.mz[:-step] <= 2 * tolerance + SLACK)
            if not close.any():
                break
            out[self.owner[step:][close]] = step + 1
        return out

    def needed(self, mode: str, limit: float, tolerance: float, query_sq: float, query_reuse: float) -> np.ndarray:
        """Positions of the ions without which no query of at most this sum of squares reaches the limit."""
        order = np.lexsort((-self.intensity, self.owner))
        owner, energy = self.owner[order], self.intensity[order] ** 2
        total = np.cumsum(energy)
        rest_sq = np.maximum((total[self.starts + self.sizes - 1])[owner] - total + energy, 0) if len(order) else energy
        rest_n = self.sizes[owner] - (np.arange(len(order)) - self.starts[owner])
        dot = np.sqrt(self.reuse(tolerance)[owner] * rest_sq * query_sq)
        dot_back = np.sqrt(query_reuse * rest_sq * query_sq)
        with np.errstate(invalid="ignore"):  # a spectrum without intensity has no score
            bound = best_score(mode, dot, dot_back, rest_n, np.float64(1), self.sizes[owner], 1, self.square[owner], query_sq)
        return np.sort(order[bound >= limit - SLACK])


def _nearer(left: np.ndarray, right: np.ndarray, left_place: np.ndarray, right_place: np.ndarray) -> np.ndarray:
    return (right < left) | ((right == left) & (right_place < left_place))


def _sums(lib: Spectra, chosen: np.ndarray, query: Spectra, q: int, tolerance: float, both: bool) -> tuple[np.ndarray, ...]:
    """dot, matched, dot_back and matched_back of one query with the chosen entries."""
    span = slice(query.starts[q], query.starts[q] + query.sizes[q])
    mz, intensity, place = query.mz[span], query.intensity[span], query.place[span]
    first = query.first[span] - query.starts[q]
    n, sizes = len(mz), lib.sizes[chosen]
    local = np.repeat(np.arange(len(chosen)), sizes)
    ions = np.arange(len(local)) + (lib.starts[chosen] - (np.cumsum(sizes) - sizes))[local]
    x = lib.mz[ions]
    after = np.searchsorted(mz, x, "left")
    right = np.minimum(after, n - 1)
    left = first[np.maximum(after - 1, 0)]
    gap_right = np.where(after < n, np.abs(mz[right] - x), np.inf)
    gap_left = np.where(after > 0, np.abs(mz[left] - x), np.inf)
    near = np.where(_nearer(gap_left, gap_right, place[left], place[right]), right, left)
    hit = np.minimum(gap_left, gap_right) <= tolerance
    dot = np.bincount(local, np.where(hit, lib.intensity[ions] * intensity[near], 0), len(chosen))
    matched = np.bincount(local, hit, len(chosen))
    if not both:
        return dot, matched, np.zeros(len(chosen)), np.zeros(len(chosen))
    # an ion of the entry is at most the query ion j when at most j query ions are below it
    below = np.bincount(local * (n + 1) + after, minlength=len(chosen) * (n + 1)).reshape(len(chosen), n + 1)
    upto = np.cumsum(below[:, :n], axis=1)
    start, last = lib.starts[chosen][:, None], sizes[:, None]
    left = lib.first[start + np.maximum(upto - 1, 0)]
    right = start + np.minimum(upto, last - 1)
    gap_left = np.where(upto > 0, np.abs(mz - lib.mz[left]), np.inf)
    gap_right = np.where(upto < last, np.abs(mz - lib.mz[right]), np.inf)
    near = np.where(_nearer(gap_left, gap_right, lib.place[left], lib.place[right]), right, left)
    hit = np.minimum(gap_left, gap_right) <= tolerance
    return dot, matched, np.where(hit, intensity * lib.intensity[near], 0).sum(axis=1), hit.sum(axis=1)


def _slabs(sizes: np.ndarray, entries: np.ndarray, n_query: int) -> Iterator[np.ndarray]:
    """The entries in pieces of bounded work."""
    if not len(entries):
        return
    cut = np.cumsum(sizes[entries] + n_query) // CELLS
    yield from np.split(entries, np.flatnonzero(np.diff(cut)) + 1)


def _partners(spectra: Spectra, some: np.ndarray, grid: np.ndarray, tolerance: float, counts: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each of some spectra with ions, and every m/z of a sorted grid without repeats: the intensity of the ion that it
    takes, and if asked for 1 if it takes one, else 0.

    Along the grid the ion taken changes halfway between two ions and is missing beyond the tolerance, so a spectrum is a few
    runs of the grid. Places at the edges of runs, where rounding decides, are compared one by one.
    """
    if len(some):
        cut = np.cumsum(spectra.sizes[some]) // (CELLS // 8)
        for slab in np.split(some, np.flatnonzero(np.diff(cut)) + 1):
            yield from _partners_of_slab(spectra, slab, grid, tolerance, counts)


@dataclass
class _Runs:
    """Some spectra as runs along a grid: the first and last ion of each, the end of the last run, length, intensity and
    presence of all runs, and the places that were compared one by one with what they take."""

    starts: np.ndarray
    stops: np.ndarray
    high: np.ndarray
    lengths: np.ndarray
    values: np.ndarray
    taken: np.ndarray
    whose: np.ndarray
    at: np.ndarray
    exact: np.ndarray
    hit: np.ndarray


def _runs(spectra: Spectra, some: np.ndarray, grid: np.ndarray, tolerance: float) -> _Runs:
    sizes, end = spectra.sizes[some], len(grid)
    owner = np.repeat(np.arange(len(some)), sizes)
    ions = np.arange(len(owner)) + (spectra.starts[some] - (np.cumsum(sizes) - sizes))[owner]
    # of ions with the same m/z the first one is taken
    distinct = spectra.first[ions] == ions
    ions, owner = ions[distinct], owner[distinct]
    mz, intensity, place = spectra.mz[ions], spectra.intensity[ions], spectra.place[ions]
    stops = np.searchsorted(owner, np.arange(len(some)), "right")
    starts = np.append(0, stops[:-1])
    following = np.append(mz[1:], np.inf)
    following[stops - 1] = np.inf
    with np.errstate(invalid="ignore"):
        halfway = (mz + following) / 2
    upper = np.searchsorted(grid, halfway)
    upper[stops - 1] = end
    lower = np.append(0, upper[:-1])
    lower[starts] = 0
    low = np.clip(np.searchsorted(grid, mz - tolerance, "left"), lower, upper)
    high = np.clip(np.searchsorted(grid, mz + tolerance, "right"), low, upper)
    before = np.append(0, high[:-1])
    before[starts] = 0
    lengths = np.stack([low - before, high - low], axis=1).ravel()
    values = np.stack([np.zeros(len(mz)), intensity], axis=1).ravel()
    taken = np.tile([0.0, 1.0], len(mz))

    edges = np.concatenate([halfway, mz - tolerance, mz + tolerance])
    first = np.searchsorted(grid, edges - SLACK, "left")
    many = np.searchsorted(grid, edges + SLACK, "right") - first
    at = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
    whose = np.repeat(np.tile(owner, 3), many)
    order = np.argsort(whose, kind="stable")
    at, whose = at[order], whose[order]
    # ions below a place of the grid are those with no place above their own
    right = np.searchsorted(owner * (end + 1) + np.searchsorted(grid, mz, "right"), whose * (end + 1) + at, "right")
    left, x = right - 1, grid[at]
    has_left, has_right = right > starts[whose], right < stops[whose]
    left, right = np.where(has_left, left, starts[whose]), np.where(has_right, right, stops[whose] - 1)
    with np.errstate(invalid="ignore"):
        gap_left = np.where(has_left, np.abs(mz[left] - x), np.inf)
        gap_right = np.where(has_right, np.abs(mz[right] - x), np.inf)
    near = np.where(_nearer(gap_left, gap_right, place[left], place[right]), right, left)
    hit = np.minimum(gap_left, gap_right) <= tolerance
    exact = np.where(hit, intensity[near], 0)
    return _Runs(starts, stops, high, lengths, values, taken, whose, at, exact, hit)


def _partners_of_slab(spectra: Spectra, some: np.ndarray, grid: np.ndarray, tolerance: float, counts: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    r, end = _runs(spectra, some, grid, tolerance), len(grid)
    last = np.searchsorted(r.whose, np.arange(len(some)), "right")
    for start, stop, since, until in zip(r.starts.tolist(), r.stops.tolist(), [0, *last[:-1].tolist()], last.tolist()):
        runs, edge = slice(2 * start, 2 * stop), r.at[since:until]
        value, present = np.zeros(end), np.zeros(end) if counts else None
        value[: r.high[stop - 1]] = np.repeat(r.values[runs], r.lengths[runs])
        value[edge] = r.exact[since:until]
        if counts:
            present[: r.high[stop - 1]] = np.repeat(r.taken[runs], r.lengths[runs])
            present[edge] = r.hit[since:until]
        yield value, present


class _Line:
    """The m/z of some spectra as one grid, for sums over the ions of each of these spectra."""

    def __init__(self, spectra: Spectra, some: np.ndarray) -> None:
        sizes = spectra.sizes[some]
        ions = np.arange(sizes.sum()) + np.repeat(spectra.starts[some] - (np.cumsum(sizes) - sizes), sizes)
        self.number, self.filled = len(some), np.flatnonzero(sizes > 0)
        self.starts, self.intensity = (np.cumsum(sizes) - sizes)[self.filled], spectra.intensity[ions]
        self.grid, self.at = np.unique(spectra.mz[ions], return_inverse=True)

    def _each(self, ions: np.ndarray) -> np.ndarray:
        out = np.zeros(self.number)
        out[self.filled] = np.add.reduceat(ions, self.starts)
        return out

    def sums(self, partners: Spectra, some: np.ndarray, tolerance: float, counts: bool) -> Iterator[tuple[np.ndarray, np.ndarray | float]]:
        """For each of some partners, dot with every spectrum, whose ions take the nearest ones of the partner, and if asked
        for how many take one."""
        for value, present in _partners(partners, some, self.grid, tolerance, counts):
            yield self._each(value[self.at] * self.intensity), self._each(present[self.at]) if counts else 0


def _on_grid(spectra: Spectra, some: np.ndarray, grid: np.ndarray, tolerance: float, counts: bool) -> tuple[np.ndarray, ...]:
    """Rows of some spectra over a sorted grid of few m/z that holds all of theirs: intensity and, if asked for, number of
    their own ions there, and intensity and presence of the ion that an ion there takes."""
    sizes, end = spectra.sizes[some], len(grid)
    row = np.repeat(np.arange(len(some)), sizes)
    ions = np.arange(len(row)) + np.repeat(spectra.starts[some] - (np.cumsum(sizes) - sizes), sizes)
    at = row * end + np.searchsorted(grid, spectra.mz[ions])
    spread = lambda **more: np.bincount(at, minlength=len(some) * end, **more).reshape(len(some), end).astype(np.float64)
    own, count = spread(weights=spectra.intensity[ions]), spread() if counts else None
    taken, hit = np.zeros((len(some), end)), np.zeros((len(some), end)) if counts else None
    filled = np.flatnonzero(sizes > 0)
    cut = np.cumsum(sizes[filled]) // (CELLS // 8)
    for rows in np.split(filled, np.flatnonzero(np.diff(cut)) + 1) if len(filled) else ():
        r = _runs(spectra, some[rows], grid, tolerance)
        # the rest of the grid behind a spectrum's last run takes nothing
        lengths = np.insert(r.lengths, 2 * r.stops, end - r.high[r.stops - 1])
        for out, values, exact in ((taken, r.values, r.exact), (hit, r.taken, r.hit)):
            if out is not None:
                some_rows = np.repeat(np.insert(values, 2 * r.stops, 0), lengths).reshape(len(rows), end)
                some_rows[r.whose, r.at] = exact
                out[rows] = some_rows
    return own, count, taken, hit


def _few_places(
    lib: Spectra, query: Spectra, rows: np.ndarray, tolerance: float, both: bool, grid: np.ndarray, counts: bool
) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The sums of each query with all entries where the ions of a block lie at few distinct m/z: products of tables over
    these m/z. All numbers are whole, so nothing is rounded."""
    own, count, taken, hit = _on_grid(lib, np.arange(len(lib.sizes)), grid, tolerance, counts)
    nothing = np.zeros(len(lib.sizes))
    step = max(1, CELLS // max(len(lib.sizes), len(grid)))
    for start in range(0, len(rows), step):
        some = rows[start : start + step]
        mine, number, given, present = _on_grid(query, some, grid, tolerance, counts)
        dot, dot_back = given @ own.T, mine @ taken.T if both else None
        matched, matched_back = present @ count.T if counts else None, number @ hit.T if both and counts else None
        for i, q in enumerate(some.tolist()):
            yield q, tuple(nothing if s is None else s[i] for s in (dot, matched, dot_back, matched_back))


@dataclass
class Leaders:
    """What is left of a query's hits in one block when only the ``k`` first of the whole ranking are wanted: those that can
    be among them, and with ``backed`` those that can be the first one with a retention index.

    The ranking is by a match factor cut to a whole number, which lies less than 2 below the score of this module, and
    with ``by_index`` by that times the factors of index and class, cut again.
    """

    k: int
    limit: float
    capped: bool = False
    by_index: bool = False
    backed: bool = False
    ri_tolerance: float = 50.0

    def keep(self, score: np.ndarray, weak: np.ndarray, factor: np.ndarray, ri: np.ndarray, expected: float | None) -> np.ndarray:
        score = np.where(weak, np.minimum(score, 500), score) if self.capped else score
        weight = np.ones(len(score))
        if self.by_index:
            gap, t = np.abs(ri - (np.nan if expected is None else expected)), self.ri_tolerance
            steps = [1.0, 1.0 - 0.5 * (gap - t) / t, 0.5 - 0.4 * (gap - t * 2) / (t * 2)]
            weight = factor * np.select([np.isnan(gap) | (gap <= t), gap <= t * 2, gap <= t * 4], steps, 0.1)
        ends = np.nan_to_num(np.stack([score * weight, (score - 2.01) * weight]))
        low, high = ends.min(axis=0) - 1.01, ends.max(axis=0) + 1.01
        # pairs near the limit may be no hits, so they displace none
        sure = score >= self.limit + 2.01
        out = self._first(low, high, sure, self.k)
        if self.backed:
            has = ~np.isnan(ri)
            out |= has & self._first(low, high, sure & has, 1)
        return out

    def _first(self, low: np.ndarray, high: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
        known = low[sure]
        return high >= np.partition(known, len(known) - k)[len(known) - k] if len(known) > k else np.ones(len(low), bool)


def indices(values: pa.ChunkedArray) -> np.ndarray:
    """Indices with NaN for null; a NaN lies far from all."""
    return pc.if_else(pc.is_nan(values), np.inf, values).to_numpy().astype(np.float64)


def pairs(
    library: pa.Table, queries: pa.Table, mode: str, limit: float, tolerance: float, both: bool, by_base_peak: bool, leaders: Leaders | None = None,
    counts: bool = True,
) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """(row of the query, rows of entries, their sums) for all pairs of two blocks that can reach the limit.

    Without ``counts``, for modes that do not score them, matched and matched_back are 0.
    """
    lib, query = Spectra.read(library.column("peaks")), Spectra.read(queries.column("peaks"))
    if not len(lib.mz) or not len(query.mz):
        return
    base = library.column("base_peak_mz").to_numpy() if by_base_peak else None
    wanted = queries.column("cand").to_pylist() if by_base_peak else None
    if not (lib.complete and query.complete):
        leaders = None
    by_index = leaders is not None and leaders.by_index
    factor, ri = (library.column("factor").to_numpy(), indices(library.column("ri_exp"))) if by_index else (lib.square, lib.square)
    expected = [-np.inf if x is not None and np.isnan(x) else x for x in queries.column("ri_expected").to_pylist()] if by_index else [None] * len(query.sizes)
    rows = np.flatnonzero((query.sizes > 0) & (query.square > 0))

    bases, base_of = np.unique(base, return_inverse=True) if by_base_peak else (np.empty(0), None)
    number_of = {b: i for i, b in enumerate(bases.tolist())}

    def near(q: int) -> np.ndarray:
        """Entries whose base peak is one of those that the query wants."""
        flags = np.zeros(len(bases), bool)
        flags[[number_of[b] for b in wanted[q] if b in number_of]] = True
        return flags[base_of]

    def chosen(q: int, entries: np.ndarray, sums: tuple[np.ndarray, ...]) -> tuple[int, np.ndarray, tuple[np.ndarray, ...]]:
        dot, matched, dot_back, matched_back = sums
        n, square = int(query.sizes[q]), query.square[q]
        score = best_score(mode, dot, dot_back, matched, matched_back, lib.sizes[entries], n, lib.square[entries], square)
        # without counts a score above 0 tells that ions are shared
        keep = np.flatnonzero((score >= limit - SLACK) & (matched > 0 if counts else score > 0))
        if leaders and len(keep) > leaders.k:
            norm = np.sqrt(lib.square[entries[keep]] * square)
            weak = np.minimum(dot[keep], dot_back[keep]) / norm * 999 < 400
            keep = keep[leaders.keep(score[keep], weak, factor[entries[keep]], ri[entries[keep]], expected[q])]
        return q, entries[keep], tuple(s[keep] if counts or not i % 2 else np.zeros(len(keep)) for i, s in enumerate(sums))

    grid = np.unique(np.concatenate([lib.mz, query.mz]))
    if len(grid) <= FEW_PLACES and len(grid) * len(lib.sizes) <= 4 * CELLS:
        useful = lib.square > 0
        for q, sums in _few_places(lib, query, rows, tolerance, both, grid, counts):
            found = useful & near(q) if by_base_peak and wanted[q] else useful
            entries = np.flatnonzero(found)
            out = chosen(q, entries, tuple(s[entries] for s in sums))
            if len(out[1]):
                yield out
        return

    index = lib.needed(mode, limit, tolerance, float(query.square.max()), float(query.reuse(tolerance).max()))
    index = index[np.argsort(lib.mz[index], kind="stable")]
    places, owners = lib.mz[index], lib.owner[index]
    total = len(lib.sizes)
    line = _Line(lib, np.arange(total))

    def reachable(q: int) -> np.ndarray:
        mz = query.mz[query.starts[q] : query.starts[q] + query.sizes[q]]
        # ions of the index near any ion of the query: intervals that may overlap
        stop = np.searchsorted(places, mz + tolerance + SLACK, "right")
        start = np.maximum(np.searchsorted(places, mz - tolerance - SLACK, "left"), np.append(0, stop[:-1]))
        found = np.zeros(total, bool)
        for some in map(slice, start.tolist(), stop.tolist()):
            found[owners[some]] = True
        if by_base_peak and wanted[q]:
            found &= near(q)
        return found & (lib.square > 0)

    step = max(1, 2 * CELLS // total)
    for begin in range(0, len(rows), step):
        some = rows[begin : begin + step]
        found = np.stack([reachable(q) for q in some.tolist()])
        # with many entries it is cheaper to look up the partner of each m/z of the block once
        wide = found.sum(axis=1) * 8 > total
        full, place = some[wide], np.cumsum(wide) - 1
        ahead, back = np.zeros((2, 2, len(full), total))
        for i, (row, sums) in enumerate(zip(np.flatnonzero(wide).tolist(), line.sums(query, full, tolerance, counts))):
            ahead[0, i], ahead[1, i] = sums
            q, entries = full[i], np.flatnonzero(found[row])
            dot, matched = ahead[:, i, entries]
            # the other direction at its most, so this is a bound
            n = int(query.sizes[q])
            bound = best_score(mode, dot, np.inf, matched, n, lib.sizes[entries], n, lib.square[entries], query.square[q])
            found[row, entries] = (bound >= limit - SLACK) & ((matched > 0) | (not counts))
        # looking up an entry's ions has a fixed price, so it needs several queries
        tabled = not both or len(full) >= FEW_QUERIES
        if both and tabled:
            entries = np.flatnonzero(found[wide].any(axis=0))
            for e, sums in zip(entries.tolist(), _Line(query, full).sums(lib, entries, tolerance, counts)):
                back[0, :, e], back[1, :, e] = sums
        for row, q in enumerate(some.tolist()):
            entries = np.flatnonzero(found[row])
            if not len(entries):
                continue
            if wide[row] and tabled:
                sums = (*ahead[:, place[row], entries], *back[:, place[row], entries])
            else:
                parts = [_sums(lib, slab, query, q, tolerance, both) for slab in _slabs(lib.sizes, entries, int(query.sizes[q]))]
                sums = tuple(np.concatenate([p[i] for p in parts]) for i in range(4))
            out = chosen(q, entries, sums)
            if len(out[1]):
                yield out
