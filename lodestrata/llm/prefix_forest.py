"""The k most similar vectors of every vector, by a forest of hash prefixes (problem 2).

Each tree hashes every vector to a long string of bits (the sides of random hyperplanes) and keeps the strings in a
sorted array.  A vector descends in every tree to its longest-prefix match; then all trees ascend in step: the common
prefix length falls bit by bit, and the vectors that share such a prefix in any tree are the candidates, until
there are enough of them.  So the length of the prefix follows the density of the data around each vector.
The candidates' cosines are exact (products of blocks of unit vectors, in float64 where float32 can't tell), and a bucket is
always searched as a whole, however many vectors it holds.

Vectors with the same numbers are one class: one of them stands in the forest for all, and the others get
its neighbours and each other.  So a group of copies, however large, neither crowds out the candidates
of others nor costs more than its rows.

Scale: a forest of ``trees`` sorted arrays lives in one task, and holds at most about ``CELL`` vectors of one model and dim: that bounds
memory, and a vector is sent once for all trees, not once for each.  Larger collections are cut into cells by the first bits of strings
of their own, so that a cell is a whole subtree; this is repeated in several groups with other strings, as a vector's neighbours can stand
in another cell of one group.  Where to cut is fitted on a bounded sample of strings (``SAMPLE`` in all), how often on the angles between
sampled vectors (``FIT_ROWS``); every vector is indexed.  A subtree of equal strings too large for a cell is cut by a projection instead.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.runtime import shuffle_tasks, written

NEIGHBOURS = 5
#: Trees of a forest, bits of a hash string, and how many candidates each tree is asked for at least, to both sides.
TREES, BITS, REACH = 16, 64, 128
#: Candidates asked for grow with the root of the vectors in the forest: the factor.
ENOUGH = 60
#: Vectors in a cell, vectors that ask in one task, and sampled strings from which the cells are cut.
CELL, SLICE, SAMPLE = 65_536, 20_480, 8_000_000
#: Sampled vectors that tell how many groups are needed: of one collection, and in all; and the most groups that are made.
FIT_ROWS, FIT_TOTAL, MOST_GROUPS = 16_384, 200_000, 40
SEED = 20
_BLOCK, _BLOCK_CELLS = 512, 4_000_000
#: Places beyond k among which float32 products find the best k, and the error of such a product.
_SPARE, _ERROR = 11, 1e-6

_UNIT = pa.schema([("id", pa.int64()), ("space", pa.string()), ("digest", pa.binary()), ("unit", pa.binary())])
_PLACE = pa.schema([("space", pa.string()), ("grp", pa.int32()), ("cell", pa.int64()), ("slice", pa.int32()), ("asks", pa.bool_()), ("id", pa.int64()), ("unit", pa.binary())])
_SAMPLED = pa.schema([("space", pa.string()), ("hashes", pa.list_(pa.int64())), ("ties", pa.list_(pa.float64()))])
_FOUND = pa.schema([("id", pa.int64()), ("other", pa.list_(pa.int64())), ("cosine", pa.list_(pa.float64()))])


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Well-formed vectors, scaled to length 1."""
    for b in batches:
        ids, models, dims = (np.array(b.column(i).to_pylist(), dtype=object) for i in range(3))
        vectors = b.column(3)
        offsets = np.asarray(vectors.offsets)
        flat = vectors.values
        broken = np.asarray(flat.is_null())
        values = np.asarray(flat.fill_null(0)).astype(np.float64)
        broken |= ~np.isfinite(values)
        bad = np.concatenate([[0], np.cumsum(broken)])
        lengths = offsets[1:] - offsets[:-1]
        good = np.array([i is not None and m is not None and d is not None and d > 0 and n == d for i, m, d, n in zip(ids, models, dims, lengths)], dtype=bool)
        good &= ~np.asarray(vectors.is_null())
        good &= bad[offsets[1:]] == bad[offsets[:-1]]
        rows: list[tuple] = []
        for d in set(dims[good].tolist()):
            at = np.flatnonzero(good & (dims == d))
            m = values[offsets[at][:, None] + np.arange(d)[None, :]]
            largest = np.abs(m).max(axis=1)
            m, at, largest = m[largest > 0], at[largest > 0], largest[largest > 0]
            m /= largest[:, None]
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            for i, u in zip(at, m.astype(np.float32)):
                space = f"{models[i]}\x1f{d}"
                data = (u + np.float32(0)).tobytes()
                rows.append((ids[i], space, hashlib.blake2b(data, digest_size=16, key=hashlib.sha256(space.encode()).digest()).digest(), data))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _UNIT)], schema=_UNIT)


@lru_cache(maxsize=64)
def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS)).astype(np.float32)


@lru_cache(maxsize=64)
def _lines(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, 1]).standard_normal((dim, trees))


def _strings(sides: np.ndarray) -> np.ndarray:
    n, bits = sides.shape
    packed = np.packbits(sides.reshape(n, bits // BITS, BITS), axis=2).reshape(n, bits // BITS, 8)
    return (packed.copy().view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def hash_strings(units: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(n, trees) of 64-bit strings whose order as signed numbers is the order of the bits."""
    return _strings((units @ _planes(units.shape[1], trees, seed)) > 0)


def _runs(strings: np.ndarray) -> np.ndarray:
    """(n, 2) of the first place and the end of each run of equal strings."""
    edges = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1], [True]]))
    return np.stack([edges[:-1], edges[1:]], axis=1)


def told_apart(units: np.ndarray, strings: np.ndarray, planes: np.ndarray, reach: int) -> np.ndarray:
    """The order of one sorted array in which runs of equal strings longer than ``reach`` are sorted by finer strings.

    The finer strings are the sides of the differences from the run's mean, on both sides of which there are
    members; a run that nothing splits keeps its order.
    """
    order = np.arange(len(units))
    todo = [(a, b) for a, b in _runs(strings) if b - a > reach]
    while todo:
        start, stop = todo.pop()
        at = order[start:stop]
        own = units[at]
        for _ in range(2):  # the first mean is only as exact as the units are
            own = own - own.mean(axis=0, dtype=np.float64).astype(np.float32)
        finer = _strings((own @ planes) > 0)[:, 0]
        by = np.argsort(finer, kind="stable")
        order[start:stop] = at[by]
        parts = _runs(finer[by])
        if len(parts) > 1:
            todo += [(start + a, start + b) for a, b in parts if b - a > reach]
    return order


def best_in_array(units: np.ndarray, k: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, others' places, cosines) of consecutive places of one sorted array.

    The candidates of a place are the ``reach`` places before and after it at least.  Where products in float32 can't tell
    which are the best, as among near copies, all are compared in float64; the cosines come from distances,
    which do not suffer from the rounding of the units' lengths.
    """
    n = len(units)
    for start in range(0, n, _BLOCK):
        stop = min(n, start + _BLOCK)
        low, high = max(0, start - reach), min(n, stop + reach)
        cosines = units[start:stop] @ units[low:high].T
        own = np.arange(start, stop)
        cosines[own - start, own - low] = -2.0
        width, spare = min(k, high - low), min(k + _SPARE, high - low)
        near = np.argpartition(-cosines, spare - 1, axis=1)[:, :spare] if spare < high - low else np.broadcast_to(np.arange(spare), (stop - start, spare))
        rough = np.sort(np.take_along_axis(cosines, near, axis=1), axis=1)
        window = units[low:high].astype(np.float64)
        squares = np.einsum("ij,ij->i", window, window)
        asked = window[own - low]
        products = np.concatenate([np.einsum("ij,ikj->ik", asked[i : i + 64], window[near[i : i + 64]]) for i in range(0, len(own), 64)])
        exact = 1 - (squares[own - low][:, None] + squares[near] - 2 * products) / 2
        exact[near == (own - low)[:, None]] = -2.0
        best = np.argpartition(-exact, width - 1, axis=1)[:, :width]
        places, found = np.take_along_axis(near, best, axis=1), np.take_along_axis(exact, best, axis=1)
        unsure = np.flatnonzero(rough[:, -width] - rough[:, 0] <= 2 * _ERROR) if spare < high - low else []
        if len(unsure):
            exact = 1 - (squares[own - low][unsure][:, None] + squares - 2 * (asked[unsure] @ window.T)) / 2
            exact[np.arange(len(unsure)), (own - low)[unsure]] = -2.0
            best = np.argpartition(-exact, width - 1, axis=1)[:, :width]
            places[unsure], found[unsure] = best, np.take_along_axis(exact, best, axis=1)
        yield start, places + low, found


def stop_depths(strings: np.ndarray, enough: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(prefix length at which each vector stops, order of each tree's sorted array, shared prefix of neighbouring places).

    ``strings`` are (n, trees) unsigned.  Ascending in step from the longest match, the prefix is shortened in all trees at once
    until the buckets of the trees hold ``enough`` vectors in all; 0 is the whole collection.
    """
    n, trees = strings.shape
    orders, shared = [], []
    for t in range(trees):
        order = np.argsort(strings[:, t], kind="stable")
        s = strings[order, t]
        differ = s[1:] ^ s[:-1]
        high = (differ >> np.uint64(32)).astype(np.float64)
        low = (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
        orders.append(order)
        shared.append(np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).astype(np.int8))
    stops = np.zeros(n, np.int8)
    open_ = np.ones(n, bool)
    for depth in range(max((int(x.max()) for x in shared if len(x)), default=0), 0, -1):
        total = np.zeros(n, np.int64)
        for order, prefix in zip(orders, shared):
            edges = np.flatnonzero(prefix < depth)
            first = np.concatenate([[0], edges + 1])
            sizes = np.diff(np.append(first, n))
            total[order] += np.repeat(sizes, sizes)
        now = open_ & (total >= enough)
        stops[now] = depth
        open_ &= ~now
        if not open_.any():
            break
    return stops, orders, shared


class _Best:
    """The best neighbours so far of every vector in a cell."""

    def __init__(self, units: np.ndarray, k: int) -> None:
        self.units, self.k, self.keep = units, k, k + 3
        self.others = np.full((len(units), self.keep), -1, np.int64)
        self.cosines = np.full((len(units), self.keep), -2.0)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def compare(self, asking: np.ndarray, targets: np.ndarray) -> None:
        """Offers ``targets`` to each of ``asking``."""
        step = max(1, _BLOCK_CELLS // len(targets))
        for i in range(0, len(asking), step):
            rows = asking[i : i + step]
            cosines = self.units[rows] @ self.units[targets].T
            cosines[targets[None, :] == rows[:, None]] = -2.0
            least = np.maximum(self.cosines[rows, self.k - 1] - 2 * _ERROR, -1.5).astype(np.float32)
            if (least <= -1.5).all():  # nothing is known of these rows yet
                self._compare_many(rows, targets, cosines)
                continue
            at = np.flatnonzero((cosines > least[:, None]).ravel())
            r = at // len(targets)
            many = np.bincount(r, minlength=len(rows)) > 4 * (self.keep + _SPARE)
            if many.any():
                self._compare_many(rows[many], targets, cosines[many])
                at, r = at[~many[r]], r[~many[r]]
            self.found.append((rows[r], targets[at - r * len(targets)], cosines.ravel()[at].astype(np.float64)))

    def _compare_many(self, rows: np.ndarray, targets: np.ndarray, cosines: np.ndarray) -> None:
        spare = min(self.k + _SPARE, len(targets))
        near = np.argpartition(-cosines, spare - 1, axis=1)[:, :spare]
        rough = np.sort(np.take_along_axis(cosines, near, axis=1), axis=1)
        sure = (rough[:, -min(self.k, spare)] - rough[:, 0] > 2 * _ERROR) | (spare == len(targets))
        at = np.flatnonzero(sure)
        self.found.append((np.repeat(rows[at], spare), targets[near[at]].ravel(), np.take_along_axis(cosines[at], near[at], axis=1).astype(np.float64).ravel()))
        at = np.flatnonzero(~sure)
        if len(at):
            # near copies: distances in float64 between differences from the mean
            middle = self.units[targets].mean(axis=0, dtype=np.float64)
            a, b = self.units[rows[at]] - middle, self.units[targets] - middle
            far = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
            far[targets[None, :] == rows[at][:, None]] = np.inf
            near = np.argpartition(far, self.k - 1, axis=1)[:, : self.k]
            self.found.append((np.repeat(rows[at], self.k), targets[near].ravel(), 1 - np.take_along_axis(far, near, axis=1).ravel() / 2))

    def settle(self) -> None:
        """Merges what was found, each neighbour once."""
        if not self.found:
            return
        rows, others, cosines = (np.concatenate(x) for x in zip(*self.found))
        self.found = []
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, self.keep), rows])
        others = np.concatenate([self.others[touched].ravel(), others])
        cosines = np.concatenate([self.cosines[touched].ravel(), cosines])
        real = (others >= 0) & (cosines > -1.5)
        rows, others, cosines = rows[real], others[real], cosines[real]
        _, once = np.unique((rows << 32) | others, return_index=True)
        rows, others, cosines = rows[once], others[once], cosines[once]
        order = np.lexsort((-cosines, rows))  # stable: ties keep the smaller id first
        rows, others, cosines = rows[order], others[order], cosines[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        top = rank < self.keep
        self.others[touched], self.cosines[touched] = -1, -2.0
        self.others[rows[top], rank[top]] = others[top]
        self.cosines[rows[top], rank[top]] = cosines[top]

    def exact(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, others, cosines in float64) of the best k."""
        for i in range(0, len(rows), 4096):
            at = rows[i : i + 4096]
            others = self.others[at]
            apart = self.units[at].astype(np.float64)[:, None, :] - self.units[np.maximum(others, 0)]
            cosines = np.where(others >= 0, 1 - np.einsum("ikj,ikj->ik", apart, apart) / 2, -2.0)
            order = np.lexsort((others, -cosines), axis=1)[:, : self.k]
            yield at, np.take_along_axis(others, order, axis=1), np.take_along_axis(cosines, order, axis=1)


def search_forest(units: np.ndarray, asks: np.ndarray, k: int, enough: int, trees: int, seed: int, hashed: Callable = hash_strings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, others' places or -1, cosines or -2) of the vectors that ask, by the forest of one cell."""
    strings = hashed(units, trees, seed).view(np.uint64) ^ np.uint64(1 << 63)
    stops, orders, shared = stop_depths(strings, enough)
    best = _Best(units, k)
    names = np.random.default_rng(seed).integers(0, 1 << 63, len(units), dtype=np.uint64)
    searched: set[tuple[int, int]] = set()
    for order, prefix in zip(orders, shared):
        asking = asks[order]
        for depth in np.unique(stops[asks]):
            edges = np.flatnonzero(prefix < depth)
            first = np.concatenate([[0], edges + 1])
            due = asking & (stops[order] == depth)
            bucket = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            for i in np.unique(bucket[due]):
                start, stop = first[i], first[i + 1] if i + 1 < len(first) else len(order)
                targets = order[start:stop]
                name = (int(depth), int(names[targets].sum()))
                if stop - start < 2 or name in searched:  # the same bucket in another tree offers nothing new
                    continue
                searched.add(name)
                best.compare(targets[due[start:stop]], targets)
        best.settle()
    yield from best.exact(np.flatnonzero(asks))


def _cell_search(k: int, reach: int, trees: int, seed: int):
    def batch(ids: np.ndarray, own: np.ndarray, others: np.ndarray, cosines: np.ndarray) -> pa.RecordBatch:
        real = cosines > -1.5
        offsets = pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[real])) for x in (ids[others], np.clip(cosines, -1, 1))]
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), *lists], schema=_FOUND)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, asks = np.concatenate([r[0] for r in held]), np.concatenate([r[1] for r in held])
        units = np.frombuffer(b"".join(x for r in held for x in r[2]), dtype=np.float32).reshape(len(ids), -1)
        order = np.argsort(ids)
        ids, asks, units = ids[order], asks[order], units[order]
        enough = max(2 * reach * trees, int(ENOUGH * math.sqrt(len(ids))))
        if len(ids) <= enough:  # all are candidates
            for start, places, cosines in best_in_array(units, k, len(ids)):
                own = np.arange(start, start + len(places))
                some = asks[own]
                yield batch(ids, own[some], places[some], cosines[some])
        elif len(ids) <= 4 * CELL:
            for own, others, cosines in search_forest(units, asks, k, enough, trees, seed):
                yield batch(ids, own, others, cosines)
        else:  # the sample did not show how large this subtree is: windows of its array, equal strings told apart
            strings = hash_strings(units, 1, seed)[:, 0]
            order = np.argsort(strings, kind="stable")
            order = order[told_apart(units[order], strings[order], _planes(units.shape[1], 1, seed)[:, :BITS], enough)]
            for start, places, cosines in best_in_array(units[order], k, enough):
                yield batch(ids, order[start : start + len(places)], order[places], cosines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for b in batches:
            # the rows of a cell arrive together
            marks = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            asks, ids, units = np.asarray(b.column(4)), np.asarray(b.column(5)), b.column(6).to_pylist()
            start = 0
            for i in range(1, len(marks) + 1):
                if i == len(marks) or marks[i] != marks[start]:
                    if key is not None and key != marks[start]:
                        yield from flush(held)
                        held = []
                    key = marks[start]
                    held.append((ids[start:i], asks[start:i], units[start:i]))
                    start = i
        if held:
            yield from flush(held)

    return run


def groups_of(n: int, cell: int | None = None) -> int:
    """How many times a collection is cut into cells, where nothing is known of its vectors."""
    cell = cell or CELL
    return 1 if n <= cell else 2 + math.ceil(1.5 * math.log2(n / cell))


def fitted_groups(units: np.ndarray, n: int, k: int, cell: int | None = None, wanted: float = 0.965) -> int:
    """How many times ``n`` vectors, of which ``units`` is a sample, must be cut into cells so that neighbours meet.

    The angles to the k-th neighbour in a quarter of the sample and in all of it tell how they shrink as a collection grows, and so
    what they are among all ``n``.  Two vectors at an angle have equal sides of a hyperplane with a known probability, and share a
    cell with that of as many bits as cut the collection; each group is a new chance.
    """
    cell = cell or CELL
    least = groups_of(n, cell)
    asked = units[: min(400, len(units) // 8)]
    if n <= cell or len(asked) < 50:
        return least

    def angles(m: int) -> np.ndarray:
        cosines = np.sort(asked @ units[:m].T, axis=1)[:, -k - 1]  # the vector itself is among them
        return np.arccos(np.clip(cosines, -1, 1))

    few, many = angles(max(len(asked) + k, len(units) // 4)), angles(len(units))
    rate = max(0.0, math.log(max(float(np.median(few)), 1e-6) / max(float(np.median(many)), 1e-6)) / math.log(4))
    near = many * (len(units) / n) ** rate
    meets = 0.9 * (1 - near / np.pi) ** math.log2(n / (0.5 * cell))
    for groups in range(least, MOST_GROUPS):
        if float(np.mean(1 - (1 - meets) ** groups)) >= wanted:
            return groups
    return MOST_GROUPS


def cut_cells(strings: np.ndarray, ties: np.ndarray, n: int, cell: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(first strings of the cells but the first, projections that cut a string too frequent for a cell).

    The cells are the largest subtrees of at most ``cell`` of the ``n`` vectors, of which ``strings`` (signed, as they sort) is a sample.
    """
    order = np.argsort(strings, kind="stable")
    s, ties = (strings[order].view(np.uint64) ^ np.uint64(1 << 63)), ties[order]
    most = max(1, int(0.8 * cell * len(s) / max(n, 1)))
    starts: list[int] = []
    finer: dict[int, np.ndarray] = {}
    todo = [(0, 0, 0, len(s))]  # prefix, its length, places
    while todo:
        prefix, depth, low, high = todo.pop()
        if high - low <= most or depth == BITS:
            starts.append(prefix)
            if high - low > most:
                parts = -(-(high - low) // most)
                finer[prefix] = np.quantile(ties[low:high], np.arange(1, parts) / parts)
            continue
        half = prefix | 1 << (BITS - 1 - depth)
        middle = low + int(np.searchsorted(s[low:high], np.uint64(half)))
        todo += [(prefix, depth + 1, low, middle), (half, depth + 1, middle, high)]
    return np.array(sorted(starts)[1:], np.uint64), finer


def _by_dim(b: pa.RecordBatch, space: int, unit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their spaces, their units) of equal dim."""
    spaces, units = np.array(b.column(space).to_pylist(), dtype=object), b.column(unit).to_pylist()
    sizes = np.array([len(x) for x in units])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, spaces[at], np.frombuffer(b"".join(units[i] for i in at), dtype=np.float32).reshape(len(at), -1)


def _group_strings(m: np.ndarray, group: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings, projections) by which one group is cut into cells."""
    return hash_strings(m, 1, seed + 1 + group)[:, 0], (m.astype(np.float64) @ _lines(m.shape[1], 1, seed + group))[:, 0]


def _sample_batches(most: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, spaces, m in _by_dim(b, 0, 1):
                hashes, ties = (np.stack(x, axis=1) for x in zip(*(_group_strings(m, g, seed) for g in range(most))))
                yield pa.RecordBatch.from_arrays([pa.array(spaces, pa.string()), pa.array(list(hashes), _SAMPLED[1].type), pa.array(list(ties), _SAMPLED[2].type)], schema=_SAMPLED)

    return run


def _cell_batches(sizes: dict[str, int], cuts: dict[str, list[tuple]], seed: int):
    """One row for each cell (or slice) that a vector stands in."""

    def rows(spaces, ids, own, grp, cell, part, asks) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(spaces, pa.string()), pa.array(np.full(n, grp, np.int32)), pa.array(cell), pa.array(np.full(n, part, np.int32)), pa.array(asks), pa.array(ids), own], schema=_PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ids = np.asarray(b.column(1))
            for at, spaces, m in _by_dim(b, 0, 2):
                for space in set(spaces):
                    some = spaces == space
                    own, ids = b.column(2).take(pa.array(at[some])).cast(pa.binary()), all_ids[at[some]]
                    names, zero = spaces[some], np.zeros(len(ids), np.int64)
                    n = sizes.get(space, 0)
                    if space not in cuts:
                        parts = max(1, -(-n // SLICE))
                        for part in range(parts):
                            yield rows(names, ids, own, 0, zero, part, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts) == part)
                        continue
                    for g, (starts, finer) in enumerate(cuts[space]):
                        strings, ties = _group_strings(m[some], g, seed)
                        s = strings.copy().view(np.uint64) ^ np.uint64(1 << 63)
                        cell = np.searchsorted(starts, s, side="right").astype(np.int64) << 20
                        for string, parts in finer.items():
                            equal = s == np.uint64(string)
                            cell[equal] += np.searchsorted(parts, ties[equal])
                        yield rows(names, ids, own, g, cell, 0, np.ones(len(ids), bool))

    return run


def _merge(k: int):
    def best(ids: np.ndarray, others: np.ndarray, cosines: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((-cosines, others, ids))
        ids, others, cosines = ids[order], others[order], cosines[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
        ids, others, cosines = ids[new], others[new], cosines[new]
        order = np.lexsort((others, -cosines, ids))
        ids, others, cosines = ids[order], others[order], cosines[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.array([], dtype=int)
        counts = np.diff(np.concatenate([first, [len(ids)]]))
        rank = np.arange(len(ids)) - np.repeat(first, counts)
        keep = rank < k
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(counts, k))]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.ListArray.from_arrays(offsets, pa.array(others[keep])), pa.ListArray.from_arrays(offsets, pa.array(cosines[keep]))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            lengths = np.asarray(b.column(1).value_lengths())
            ids = np.repeat(np.asarray(b.column(0)), lengths)
            now = (ids, np.asarray(b.column(1).flatten()), np.asarray(b.column(2).flatten()))
            now = tuple(np.concatenate(x) for x in zip(held, now)) if held else now
            if len(now[0]):
                last = int(np.searchsorted(now[0], now[0][-1]))  # the last id may go on in the next batch
                if last:
                    yield best(*(x[:last] for x in now))
                held = tuple(x[last:] for x in now)
        if held is not None and len(held[0]):
            yield best(*held)

    return run


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, reach: int = REACH, seed: int = SEED) -> DataFrame:
    """``embedding_id, rank, neighbour_id, cosine``: the k most similar vectors of the same model and dim.

    Approximate: a neighbour is missed if it shares no prefix with the vector in any tree when enough candidates are met: ``2 * reach``
    of each tree, but not less than ``ENOUGH`` times the root of the vectors in the cell (see the README for recall).

    Defined cases: vectors are well-formed if model and vector are not null, the vector has exactly
    ``dim`` entries, all finite and none null, and not all are zero; others neither ask nor answer.  Exact repeats count
    once; of differing rows with one id, one holds.  Ties go to the smaller id.  A vector alone in its model
    and dim gives no row; fewer than k others give fewer rows; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    raw = embeddings.select(F.col("embedding_id").cast("long"), F.col("model"), F.col("dim").cast("int"), F.col("vector").cast("array<float>"))
    units = raw.mapInArrow(_unit_batches, "id long, space string, digest binary, unit binary")
    classes = units.groupBy("digest").agg(F.min("id").alias("rep"), F.min_by("unit", "id").alias("unit"), F.min_by("space", "id").alias("space"))
    reps = written(classes, "forest-classes")
    members = units.groupBy("id").agg(F.min("digest").alias("digest")).join(reps.select("digest", "rep"), "digest").select("id", "rep")
    # at most one row for each SLICE vectors comes to the driver
    sizes = {r[0]: r[1] for r in reps.groupBy("space").count().filter(F.col("count") > SLICE).collect()}
    groups = {s: groups_of(n) for s, n in sizes.items() if n > CELL}
    cuts: dict[str, list[tuple]] = {}
    if groups:
        fit_rows = min(FIT_ROWS, FIT_TOTAL // len(groups))
        large = F.broadcast(spark.createDataFrame([(s, int((1 << 20) * fit_rows / sizes[s])) for s in groups], "space string, few int"))
        fit = reps.join(large, "space").filter(F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(1 << 20)) < F.col("few")).select("space", "unit").toArrow()
        named = np.array(fit.column(0).to_pylist(), dtype=object)
        for space in groups:
            own = [x for x, it in zip(fit.column(1).to_pylist(), named == space) if it]
            units = np.frombuffer(b"".join(own), dtype=np.float32).reshape(len(own), -1) if own else np.zeros((0, 1), np.float32)
            groups[space] = fitted_groups(units, sizes[space], k)
        most = max(groups.values())
        share = min(1.0, SAMPLE / most / sum(sizes[s] for s in groups))
        some = reps.join(large, "space", "left_semi").filter(F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(share * (1 << 20)))
        sample = some.select("space", "unit").mapInArrow(_sample_batches(most, seed), "space string, hashes array<long>, ties array<double>").toArrow().combine_chunks()
        of = np.array(sample.column(0).to_pylist(), dtype=object)
        hashes, ties = (np.concatenate([np.asarray(c.flatten()) for c in sample.column(i).chunks] or [np.zeros(0)]).reshape(-1, most) for i in (1, 2))
        for space, n_groups in groups.items():
            at = np.flatnonzero(of == space)
            cuts[space] = [cut_cells(hashes[at, g].astype(np.int64), ties[at, g], sizes[space], CELL) for g in range(n_groups)]
    heavy = sum(sum(len(starts) + 1 + sum(map(len, finer.values())) for starts, finer in c) for c in cuts.values()) + sum(-(-n // SLICE) for s, n in sizes.items() if s not in cuts)
    tasks = max(shuffle_tasks(spark), min(8 * heavy, 3 * heavy + 64))  # more than cells, as several can meet in one task
    places = reps.select("space", F.col("rep").alias("id"), "unit").mapInArrow(_cell_batches(sizes, cuts, seed), "space string, grp int, cell long, slice int, asks boolean, id long, unit binary")
    key = ["space", "grp", "cell", "slice"]
    cells = places.repartition(tasks, *key).sortWithinPartitions(*key)
    found = cells.mapInArrow(_cell_search(k, reach, trees, seed), "id long, other array<long>, cosine array<double>")
    merged = found.repartition(shuffle_tasks(spark) if not cuts else tasks, "id").sortWithinPartitions("id").mapInArrow(_merge(k), "id long, other array<long>, cosine array<double>")
    # the first k + 1 ids of each class stand for its copies; the filter on row_number limits groups before the shuffle
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1)
    heads = first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("heads"))
    others = merged.select(F.col("id").alias("rep"), F.explode(F.arrays_zip("other", "cosine")).alias("x")).select("rep", F.col("x.other").alias("to"), F.col("x.cosine").cast("double").alias("cosine"))
    spread = others.join(heads.select(F.col("rep").alias("to"), F.col("heads")), "to").groupBy("rep").agg(F.flatten(F.collect_list(F.transform("heads", lambda i: F.struct((-F.col("cosine")).alias("far"), i.alias("id"))))).alias("near"))
    twins = F.transform("heads", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id")))
    none = F.array().cast("array<struct<far: double, id: bigint>>")
    answers = members.join(heads, "rep").join(spread, "rep", "left")
    best = F.slice(F.array_sort(F.filter(F.concat(twins, F.coalesce("near", none)), lambda x: x["id"] != F.col("id"))), 1, k)
    return answers.select("id", F.posexplode(best).alias("pos", "x")).select(F.col("id").alias("embedding_id"), (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.round(-F.col("x.far"), 6).alias("cosine"))


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """``embedding_id_a, embedding_id_b`` (smaller first) of neighbours whose cosine is at least ``least``."""
    near = neighbours.filter(F.col("cosine") >= least)
    return near.select(F.least("embedding_id", "neighbour_id").alias("embedding_id_a"), F.greatest("embedding_id", "neighbour_id").alias("embedding_id_b")).distinct()
