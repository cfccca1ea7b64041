"""Normal equations as mergeable states, built in one pass over the rows.

A state holds, for some rows of one model, the weighted cross-products of the
columns, their sums for each level of each factor, and the joint weight of each
pair of levels that occurs. States of different rows add up. Joint weights that are
small whole numbers, as the counts of replicates are, take a byte or two. With an n x G matrix
of weights one state serves G replicates at once: whatever does not depend on the
weights (reading the rows, numbering levels, sorting pairs) is done once for all.

Every task folds its rows into states in Arrow batches and hands on the states
only, packed; they are added up in a tree. A state that outgrows ``STATE_BYTES``, or
whose pairs outgrow ``PAIR_BYTES`` (sorting and dealing them takes several times as
much; for replicates ``DRAWN_PAIR_BYTES``), is handed on early and a new one begun, so a task's memory is bounded.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

STATE_BYTES = 128 << 20
PAIR_BYTES = 32 << 20
# The same for replicates, where a pair's weights take far more than sorting it does.
DRAWN_PAIR_BYTES = 96 << 20
# Pairs are held unsorted up to this many times what sorting left of them.
SLACK = 3
# Cells of a block of products that is worked on at once.
CELLS = 4 << 20
# Groups of rows with the same columns empty that are worth a product each, and rows of a group.
GROUPS = 64
GROUP_ROWS = 64
# Pairs of levels of two factors up to which each has a cell of its own.
GRID = 1 << 18
GRID_ROWS = 64
# Rows of a run that are added one after another for all runs at once.
SHORT_RUN = 16
FAN = 32
REST = -1


@dataclass
class State:
    """Sums of some rows: ``p`` columns (the outcome first), ``m`` factors, ``g`` weights a row, ``e`` further sums."""

    p: int
    m: int
    g: int = 1
    e: int = 0
    levels: list[dict[str, int]] = field(default_factory=list)
    totals: np.ndarray | None = None  # g x (rows, weight, further sums)
    cross: np.ndarray | None = None  # g x p x p
    sums: list[np.ndarray] = field(default_factory=list)  # per factor: levels x g x (weight, columns)
    pairs: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    held: int = 0
    held_bytes: int = 0
    sorted_size: int = 0
    grids: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # pairs with a cell each, until sorted

    def __post_init__(self) -> None:
        if self.totals is None:
            self.totals = np.zeros((self.g, 2 + self.e))
            self.cross = np.zeros((self.g, self.p, self.p))
            self.levels = [{} for _ in range(self.m)]
            self.sums = [np.zeros((0, self.g, 1 + self.p)) for _ in range(self.m)]
            self.pairs = {(i, j): [] for i in range(self.m) for j in range(i + 1, self.m)}

    def codes(self, i: int, names: Sequence[str]) -> np.ndarray:
        """Numbers of levels, new ones included."""
        own = self.levels[i]
        out = np.array([own.setdefault(name, len(own)) for name in names], np.int64)
        short = len(own) - len(self.sums[i])
        if short > 0:
            self.sums[i] = np.concatenate((self.sums[i], np.zeros((short, self.g, 1 + self.p))))
        return out

    def add(
        self, z: np.ndarray, w: np.ndarray, codes: list[np.ndarray], extra: np.ndarray,
        groups: list[tuple[np.ndarray, np.ndarray]] | None = None,
    ) -> None:
        """Rows: columns n x p, weights n x g, level numbers, further columns n x e (times each weight).

        ``groups`` parts the rows by the columns that may differ from zero.
        """
        self.totals[:, 0] += (w != 0).sum(axis=0)
        self.totals[:, 1] += w.sum(axis=0)
        if self.e:
            self.totals[:, 2:] += extra.sum(axis=0)
        self._add_cross(z, w, groups)
        if self.g == 1:
            self._add_single(z, w[:, 0], codes)
            self._settle()
            return
        full = np.column_stack((np.ones(len(z)), z))
        for i in range(self.m):
            order = np.argsort(codes[i], kind="stable")
            found, starts = _starts(codes[i][order])
            # A product a level: the weighted columns of all replicates are never laid out.
            weights, columns = w[order], full[order]
            for level, a, b in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
                self.sums[i][level] += weights[a:b].T @ columns[a:b]
        counts = _tight(w)
        for (i, j), held in self.pairs.items():
            both = (codes[i] << 32) | codes[j]
            order = np.argsort(both, kind="stable")
            found, starts = _starts(both[order])
            self._hold(held, found, _tight(_folded_values(counts, order, starts)))
        self._settle()

    def _add_single(self, z: np.ndarray, w: np.ndarray, codes: list[np.ndarray]) -> None:
        """Sums per level and joint weights for one weight a row, counted into bins; of sparse columns only what is there."""
        n, columns = len(w), [(None, w)]
        for column in np.ascontiguousarray(z.T if (w == 1).all() else z.T * w):
            there = np.flatnonzero(column)
            columns.append((there, column[there]) if len(there) * 3 < n else (None, column))
        for i in range(self.m):
            size, found, own = len(self.sums[i]), slice(None), codes[i]
            if size > n:
                found, own = np.unique(own, return_inverse=True)
                size = len(found)
            binned = [np.bincount(own if at is None else own[at], values, size) for at, values in columns]
            self.sums[i][found, 0] += np.stack(binned, axis=1)
        rows = self.totals[0, 0]
        for (i, j), held in self.pairs.items():
            shape = len(self.levels[i]), len(self.levels[j])
            if n >= GRID_ROWS and shape[0] * shape[1] <= min(GRID, 32 * n, 2 * rows):
                # Few enough pairs for a cell each.
                grid = self.grids.get((i, j))
                if grid is None or grid.shape != shape:
                    wider = np.zeros(shape)
                    if grid is not None:
                        wider[: grid.shape[0], : grid.shape[1]] = grid
                    grid = self.grids[i, j] = wider
                grid += np.bincount(codes[i] * shape[1] + codes[j], w, grid.size).reshape(shape)
                continue
            both = (codes[i] << 32) | codes[j]
            order = np.argsort(both, kind="stable")
            found, starts = _starts(both[order])
            self._hold(held, found, _tight(np.add.reduceat(w[order], starts)[:, None]))

    def _add_cross(self, z: np.ndarray, w: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        """Weighted cross-products; for replicates from the products of each two columns, some rows at a time."""
        if self.g == 1 and groups is not None:
            for rows, columns in groups:
                part = z[rows[:, None], columns]
                self.cross[0][columns[:, None], columns] += (part * w[rows]).T @ part
            return
        one, two = np.triu_indices(self.p)
        some = CELLS // max(len(one), 1)
        if self.g == 1 or some < self.g:
            for g in range(self.g):
                self.cross[g] += (z * w[:, g : g + 1]).T @ z
            return
        found = np.zeros((self.g, len(one)))
        for low in range(0, len(z), some):
            found += w[low : low + some].T @ (z[low : low + some, one] * z[low : low + some, two])
        self.cross[:, one, two] += found
        self.cross[:, two, one] += np.where(one == two, 0.0, found)

    def _hold(self, held: list, found: np.ndarray, values: np.ndarray) -> None:
        held.append((found, values))
        self.held += len(found)
        self.held_bytes += found.nbytes + values.nbytes

    def _settle(self) -> None:
        if self.held > SLACK * self.sorted_size + 100_000:
            self.compact()

    def compact(self) -> None:
        for (i, j), grid in self.grids.items():
            a, b = np.nonzero(grid)
            self._hold(self.pairs[i, j], (a << 32) | b, _tight(grid[a, b][:, None]))
        self.grids = {}
        for key, held in self.pairs.items():
            if len(held) > 1:
                both = np.concatenate([h[0] for h in held])
                values = np.concatenate([h[1] for h in held])
                held.clear()
                order = np.argsort(both, kind="stable")
                found, starts = _starts(both[order])
                self.pairs[key] = [(found, _tight(_folded_values(values, order, starts)))]
        self.held = self.sorted_size = sum(len(h[0]) for held in self.pairs.values() for h in held)
        self.held_bytes = sum(h[0].nbytes + h[1].nbytes for held in self.pairs.values() for h in held)

    def merge(self, other: State) -> None:
        self.totals += other.totals
        self.cross += other.cross
        to = [self.codes(i, list(other.levels[i])) for i in range(self.m)]
        for i in range(self.m):
            self.sums[i][to[i]] += other.sums[i]
        for (i, j), held in other.pairs.items():
            for both, values in held:
                moved = (to[i][both >> 32] << 32) | to[j][both & 0xFFFFFFFF]
                self._hold(self.pairs[i, j], moved, values)
        self._settle()

    def bytes(self) -> int:
        return self.held_bytes + sum(x.nbytes for x in self.grids.values()) + sum(s.nbytes for s in self.sums) + self.cross.nbytes

    def pair(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels of both factors and weights (pairs x g), of a compact state."""
        held = self.pairs[i, j]
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros((0, self.g))
        return held[0][0] >> 32, held[0][0] & 0xFFFFFFFF, held[0][1]

    def packed(self) -> bytes:
        self.compact()
        data = pickle.dumps(self, protocol=5)
        return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)

    @staticmethod
    def unpacked(data: bytes) -> State:
        size = int.from_bytes(data[:8], "little")
        return pickle.loads(pa.decompress(memoryview(data)[8:], decompressed_size=size, codec="zstd"))

    def share(self, first: int, stop: int) -> State:
        """The part of some of the replicates."""
        self.compact()
        pairs = {k: [(b, v[:, first:stop]) for b, v in held] for k, held in self.pairs.items()}
        sums = [s[:, first:stop] for s in self.sums]
        out = State(
            self.p, self.m, stop - first, self.e, self.levels, self.totals[first:stop], self.cross[first:stop], sums, pairs
        )
        out.held = out.sorted_size = self.held
        return out

    def some_columns(self, at: Sequence[int]) -> State:
        """The state of some of the columns, in the order given."""
        at = list(at)
        sums = [s[:, :, [0, *(c + 1 for c in at)]] for s in self.sums]
        out = State(len(at), self.m, self.g, self.e, self.levels, self.totals, self.cross[:, at][:, :, at], sums, self.pairs)
        out.held = out.sorted_size = self.held
        return out

    def dealt(self, wide: int, buckets: int) -> dict[int, State]:
        """By bucket what belongs to levels of one factor, and the rest as ``REST``."""
        self.compact()
        names = list(self.levels[wide])
        of = np.array([zlib.crc32(n.encode()) % buckets for n in names], np.int64)
        out: dict[int, State] = {}
        rest = State(self.p, self.m, self.g, self.e)
        rest.totals, rest.cross = self.totals, self.cross
        others = [i for i in range(self.m) if i != wide]
        for i in others:
            rest.levels[i], rest.sums[i] = dict(self.levels[i]), self.sums[i]
        rest.pairs = {k: ([] if wide in k else held) for k, held in self.pairs.items()}
        out[REST] = rest
        for bucket in np.unique(of).tolist():
            mine = np.flatnonzero(of == bucket)
            new = np.full(len(names), -1, np.int64)
            new[mine] = np.arange(len(mine))
            part = State(self.p, self.m, self.g, self.e)
            part.levels[wide] = {names[k]: n for n, k in enumerate(mine.tolist())}
            part.sums[wide] = self.sums[wide][mine]
            for i in others:
                key = (min(i, wide), max(i, wide))
                a, b, values = self.pair(*key)
                big, other = (a, b) if wide < i else (b, a)
                keep = new[big] >= 0
                big, other, values = new[big[keep]], other[keep], values[keep]
                # Only the other factor's levels that are met here.
                seen, other = np.unique(other, return_inverse=True)
                all_names = list(self.levels[i])
                part.levels[i] = {all_names[k]: n for n, k in enumerate(seen.tolist())}
                part.sums[i] = np.zeros((len(seen), self.g, 1 + self.p))
                both = (big << 32) | other if wide < i else (other << 32) | big
                part.pairs[key] = [(both, values)]
            part.held = sum(len(h[0]) for held in part.pairs.values() for h in held)
            part.compact()
            out[bucket] = part
        rest.held = sum(len(h[0]) for held in rest.pairs.values() for h in held)
        rest.compact()
        return out


def _tight(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them exactly."""
    if values.dtype.itemsize <= 2:
        return values
    top = values.max(initial=0)
    if not top <= 65_535 or values.min(initial=0) < 0:
        return values.astype(float, copy=False)
    small = values.astype(np.uint8 if top <= 255 else np.uint16)
    return small if values.dtype != np.float64 or (small == values).all() else values


def _folded_values(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of the ordered rows in full precision, some rows or columns at a time.

    Most runs are short: their first rows are laid out, then the second ones added, and so on.
    Small whole numbers are added as such.
    """
    length = np.diff(np.append(starts, len(order)))
    whole = values.dtype.itemsize <= 2 and length.max(initial=0) <= 65_536
    kind = np.uint32 if whole else np.float64
    width = values.shape[1]
    if width == 1 or not len(starts):
        return np.add.reduceat(values[order].astype(kind), starts, axis=0) if len(starts) else np.zeros((0, width))
    out = np.empty((len(starts), width), kind)
    some = max(1, CELLS // width)
    for low in range(0, len(starts), some):
        first, own = starts[low : low + some], length[low : low + some]
        part = values[order[first]].astype(kind)
        for k in range(1, min(int(own.max()), SHORT_RUN)):
            more = np.flatnonzero(own > k)
            part[more] += values[order[first[more] + k]]
        out[low : low + some] = part
    for at in np.flatnonzero(length > SHORT_RUN).tolist():
        first, stop = int(starts[at]), int(starts[at] + length[at])
        for low in range(first + SHORT_RUN, stop, some):
            out[at] += values[order[low : min(stop, low + some)]].sum(axis=0, dtype=kind)
    return out


def _starts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array and where each starts."""
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    return ordered[starts], starts


@dataclass(frozen=True)
class Plan:
    """What a pass over the rows collects."""

    keys: tuple[str, ...]
    columns: tuple[str | tuple[str, str], ...]  # the outcome, then the terms; of a class its column and the level that counts as one
    factors: tuple[str, ...]
    weight: str
    extra: tuple[str, ...] = ()
    # Weights of each replicate from the row's seed columns; none for a single fit.
    draw: Callable[[list[np.ndarray]], np.ndarray] | None = None
    seeds: tuple[str, ...] = ()
    replicates: int = 1
    group: int = 1  # replicates that travel together
    wide: int | None = None  # the factor that is dealt into buckets
    buckets: int = 1
    # Of each term the places of the columns behind the outcome that it is the product of; none: the columns are the terms.
    layout: tuple[tuple[int, ...], ...] | None = None

    @property
    def p(self) -> int:
        return len(self.columns) if self.layout is None else 1 + len(self.layout)


def read(columns: Sequence[str | tuple[str, str]]) -> list[str]:
    """The columns to be read."""
    return list(dict.fromkeys(c if isinstance(c, str) else c[0] for c in columns))


def numbers_of(batch: pa.RecordBatch, columns: Sequence[str | tuple[str, str]]) -> list[np.ndarray]:
    """Columns as numbers, levels of a class as 0 and 1."""
    classes: dict[str, tuple[np.ndarray, dict[str, int]]] = {}
    out = []
    for c in columns:
        if isinstance(c, str):
            out.append(np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float))
            continue
        name, level = c
        if name not in classes:
            coded = batch.column(name).dictionary_encode()
            classes[name] = coded.indices.to_numpy(zero_copy_only=False), {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
        codes, found = classes[name]
        out.append((codes == found.get(level, -1)).astype(float))
    return out


def laid_out(columns: Sequence[np.ndarray], layout: tuple[tuple[int, ...], ...] | None, out: np.ndarray) -> np.ndarray:
    """Terms x rows of the columns that they are products of."""
    for i, parts in enumerate([(i,) for i in range(len(columns))] if layout is None else layout):
        out[i] = columns[parts[0]]
        for part in parts[1:]:
            out[i] *= columns[part]
    return out


class Alike:
    """Parts rows by which of the columns that lead products, as those of classes do, are zero."""

    def __init__(self, layout: tuple[tuple[int, ...], ...] | None):
        self.layout = layout or ()
        self.lead = sorted({parts[0] for parts in self.layout if len(parts) > 1})
        self.known: dict[tuple, np.ndarray] = {}

    def groups(self, columns: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rows of each group and the places of the outcome and of the terms that may differ from zero there."""
        n = len(columns[0]) if len(columns) else 0
        empty = [c for c in self.lead if np.count_nonzero(columns[c]) * 2 < n][:62]
        if len(empty) < 2:
            return None
        mask = np.zeros(n, np.int64)
        for bit, c in enumerate(empty):
            mask |= (columns[c] != 0).astype(np.int64) << bit
        order = np.argsort(mask, kind="stable")
        found, starts = _starts(mask[order])
        if len(found) > GROUPS or len(found) * GROUP_ROWS > n:
            return None
        ends = [*starts[1:].tolist(), n]
        return [(order[a:b], self._columns(m, tuple(empty))) for m, a, b in zip(found.tolist(), starts.tolist(), ends, strict=True)]

    def _columns(self, mask: int, empty: tuple[int, ...]) -> np.ndarray:
        at = mask, empty
        if at not in self.known:
            zero = {c for bit, c in enumerate(empty) if not mask >> bit & 1}
            self.known[at] = np.array([0, *(1 + i for i, parts in enumerate(self.layout) if not zero & set(parts))])
        return self.known[at]


def _key_groups(batch: pa.RecordBatch, keys: tuple[str, ...]) -> list[tuple[tuple, np.ndarray | None]]:
    if not keys:
        return [((), None)]
    frame = pa.Table.from_batches([batch.select(list(keys))]).to_pandas()
    number = frame.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(number, kind="stable")
    found, starts = _starts(number[order])
    ends = np.append(starts[1:], len(order))
    columns = [batch.column(k) for k in keys]
    out = []
    for a, b in zip(starts, ends, strict=True):
        at = order[a:b]
        out.append((tuple(c[int(at[0])].as_py() for c in columns), at))
    return out


def _handed(states: dict[tuple, State], plan: Plan, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for key, state in states.items():
        for number, low in enumerate(range(0, state.g, plan.group)):
            share = state.share(low, min(state.g, low + plan.group)) if state.g > plan.group else state
            parts = {0: share} if plan.wide is None else share.dealt(plan.wide, plan.buckets)
            for bucket, part in parts.items():
                values = [*key, number, bucket, part.packed()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def _outgrown(states: dict[tuple, State], pair_bytes: int | None = None) -> bool:
    """Whether the states are to be handed on, which sorting their pairs may still put off."""
    held = lambda: sum(s.held_bytes for s in states.values())
    pair_bytes = PAIR_BYTES if pair_bytes is None else pair_bytes
    if held() > pair_bytes:
        for state in states.values():
            state.compact()
        if held() > pair_bytes // 2:
            return True
    return sum(s.bytes() for s in states.values()) > STATE_BYTES


def _folded(plan: Plan, schema: pa.Schema):
    p, m = plan.p, len(plan.factors)
    alike = Alike(plan.layout)

    def numbers(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
        return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, State] = {}
        for batch in batches:
            if not len(batch):
                continue
            y, *columns = numbers_of(batch, plan.columns)
            z = np.empty((p, len(batch)))
            z[0] = y
            laid_out(columns, plan.layout, z[1:])
            if plan.layout is not None and not np.isfinite(z.sum()) and (gone := np.isnan(z).any(axis=0)).any():
                # Products of nothing and what has no bound: such rows are incomplete.
                batch, z, columns = batch.filter(pa.array(~gone)), z[:, ~gone], [c[~gone] for c in columns]
                if not len(batch):
                    continue
            z = z.T
            w = numbers(batch, [plan.weight])
            extra = numbers(batch, plan.extra) if plan.extra else np.zeros((len(batch), 0))
            if plan.draw is not None:
                w = w * plan.draw([batch.column(s).to_numpy(zero_copy_only=False) for s in plan.seeds])
            if not all(np.isfinite(a.sum()) or np.isfinite(a).all() for a in (z, w, extra)):
                raise ValueError("the weighted sums are not finite")
            coded = [batch.column(f).dictionary_encode() for f in plan.factors]
            local = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
            names = [c.dictionary.to_pylist() for c in coded]
            for key, at in _key_groups(batch, plan.keys):
                state = states.setdefault(key, State(p, m, plan.replicates, len(plan.extra)))
                codes = []
                for i in range(m):
                    mine = local[i] if at is None else local[i][at]
                    met, mine = np.unique(mine, return_inverse=True)
                    codes.append(state.codes(i, [names[i][k] for k in met])[mine])
                if at is None:
                    state.add(z, w, codes, extra, alike.groups(columns) if plan.draw is None else None)
                else:
                    state.add(z[at], w[at], codes, extra[at])
            if _outgrown(states, None if plan.draw is None else DRAWN_PAIR_BYTES):
                yield from _handed(states, plan, schema)
                states = {}
        yield from _handed(states, plan, schema)

    return run


def _merged(n_keys: int, schema: pa.Schema):
    """States of one key, group and bucket lie one behind another: they are added up as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((*at, state.packed()), schema, strict=True)], schema=schema
            )

        for batch in batches:
            columns = [batch.column(i) for i in range(n_keys + 2)]
            for i in range(len(batch)):
                key = tuple(c[i].as_py() for c in columns)
                one = State.unpacked(batch.column(n_keys + 2)[i].as_py())
                if key != at:
                    if state is not None:
                        yield out()
                    at, state = key, one
                else:
                    state.merge(one)
        if state is not None:
            yield out()

    return run


def partial_states(rows: DataFrame, plan: Plan) -> tuple[DataFrame, StructType]:
    """keys, ``__group`` of replicates, ``__bucket``, ``__state``, as the tasks hand them on."""
    wanted = [*plan.keys, *read(plan.columns), plan.weight, *plan.extra, *plan.seeds, *plan.factors]
    rows = rows.select(*dict.fromkeys(wanted))
    if plan.keys:
        # A batch then holds few keys.
        rows = rows.sortWithinPartitions(*plan.keys)
    fields = [rows.schema[k] for k in plan.keys]
    schema = StructType(
        [*fields, StructField("__group", IntegerType()), StructField("__bucket", IntegerType()), StructField("__state", BinaryType())]
    )
    return rows.mapInArrow(_folded(plan, to_arrow_schema(schema)), schema), schema


def states(rows: DataFrame, plan: Plan) -> DataFrame:
    """One state for each key, group of replicates and bucket, with all rows folded in."""
    found, schema = partial_states(rows, plan)
    return merged_states(found, schema, plan)


def merged_states(found: DataFrame, schema: StructType, plan: Plan) -> DataFrame:
    """The partial states of all tasks, added up."""
    arrow = to_arrow_schema(schema)
    names = [*plan.keys, "__group", "__bucket"]
    cores = found.sparkSession.sparkContext.defaultParallelism
    if cores > FAN:
        # Two levels: no task adds up the states of all tasks.
        found = found.withColumn("__branch", F.pmod(F.spark_partition_id(), F.lit(-(-cores // FAN))))
        found = found.repartition(*names, "__branch").sortWithinPartitions(*names, "__branch").drop("__branch")
        found = found.mapInArrow(_merged(len(plan.keys), arrow), schema)
    if plan.draw is not None and not plan.keys:
        # Groups of replicates are alike, so each of their buckets gets a task of its own.
        slots, first = plan.buckets + (plan.wide is not None), int(plan.wide is not None)
        at = F.col("__group") * F.lit(slots) + F.col("__bucket") + F.lit(first)
        merged = found.repartitionById(-(-plan.replicates // plan.group) * slots, at).sortWithinPartitions(*names)
        return merged.mapInArrow(_merged(len(plan.keys), arrow), schema)
    # Buckets of a slice meet in one task, which may then add up what it makes of them.
    slices = min(cores, math.isqrt(plan.buckets - 1) + 1)
    dealt = [F.col(k) for k in (*plan.keys, "__group")] + [F.pmod(F.col("__bucket"), F.lit(slices))]
    # A number of its own: states are few and heavy, their count says more than their bytes.
    merged = found.repartition(max(cores, plan.buckets), *(dealt if plan.buckets > 1 else names)).sortWithinPartitions(*names)
    return merged.mapInArrow(_merged(len(plan.keys), arrow), schema)
