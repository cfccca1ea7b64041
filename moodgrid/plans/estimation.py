"""Least squares with absorbed factors as Spark aggregations.

With numeric columns X, an outcome y, weights w and factors F1..Fm the normal
equations need only weighted sums: the cross-products of (y, X), the sums of
(y, X) per level of each factor, and the joint weight of each pair of levels.
One pass over the rows folds them into states (``accumulate``), which add up.
What is left is a system in the factor levels, one per key (replicate, region,
model). The factor with most levels is eliminated first, as its block is
diagonal. Three ways, with the same results:

- few levels in all: a key's state is solved in one task;
- one wide factor (``MAX_LEVELS`` exceeded): its levels are dealt into buckets,
  each bucket eliminates its own, and only the system of the other levels meets
  in one task;
- two wide factors (``REST_LEVELS`` exceeded without the widest): conjugate
  gradients over the pairs of levels, in one task up to ``MAX_PAIRS`` of them and
  over written tables beyond, see ``sparse``.

The rank of the level effects is that of the whole system in each of them.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial, reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from moodgrid.functions.basis import Terms
from moodgrid.operators.joins import lookup_join
from moodgrid.operators.sampling import draws, seeds, with_replicates
from moodgrid.plans.accumulate import REST, Plan, State, states
from moodgrid.session import cut_lineage

MAX_LEVELS = 6_000
REST_LEVELS = 4_000
BUCKET_LEVELS = 2_000
MAX_PAIRS = 20_000_000
TOTALS, COEF, LEVEL, FIT = "totals", "coef", "level", "fit"
SOLUTION = "kind string, term string, level string, estimate double, std_error double, vec array<double>"
COLLINEAR = 1e-9
RIDGE = 1e-9
GROUP = 5
# Settings while a fit is planned; the JVM compiles methods of up to 8,000 bytes.
# States and blocks are heavy: of those that travel to a Python worker at once the bytes are bounded.
PLANNING = {
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


@dataclass(frozen=True)
class Design:
    """A frame reduced to keys, ``w``, ``y``, ``x0..`` and ``f0..``.

    Without a ``layout`` the numbers x are the terms; with it the terms are products of ``parts``:
    names of numbers, or a name of a class ``c0..`` and the level that counts as one.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    terms: tuple[str, ...]
    factors: tuple[str, ...]
    layout: tuple[tuple[int, ...], ...] | None = None
    parts: tuple[str | tuple[str, str], ...] | None = None

    @property
    def numbers(self) -> tuple[str | tuple[str, str], ...]:
        return tuple(f"x{i}" for i in range(len(self.terms))) if self.parts is None else self.parts

    def whole(self) -> Design:
        """The design with a number for each term."""
        if self.layout is None:
            return self
        columns = [F.col(p) if isinstance(p, str) else (F.col(p[0]) == F.lit(p[1])).cast("double") for p in self.parts]
        products = [reduce(mul, (columns[p] for p in parts)).alias(f"x{i}") for i, parts in enumerate(self.layout)]
        gone = {p if isinstance(p, str) else p[0] for p in self.parts}
        rows = self.rows.select(*(c for c in self.rows.columns if c not in gone), *products)
        return Design(rows.na.drop("any", subset=[f"x{i}" for i in range(len(self.terms))]), self.keys, self.terms, self.factors)


def design(
    df: DataFrame,
    y: str | Column,
    terms: dict[str, Column],
    factors: Sequence[str] = (),
    weight: str | Column | None = None,
    keys: Sequence[str] = (),
    keep: Sequence[str] = (),
    compact: bool = False,
) -> Design:
    """Evaluate the columns of a model and drop incomplete rows.

    ``compact`` leaves out terms that are products of other ones, and has one column for all levels of a class.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    names, layout, parts, classes = tuple(terms), None, None, {}
    if compact and isinstance(terms, Terms) and (terms.made or terms.flags):
        types = dict(df.dtypes)
        flags = {n: f for n, f in terms.flags.items() if types.get(f[0]) == "string"}
        base, layout = terms.layout()
        for factor, _ in (flags[n] for n in base if n in flags):
            classes.setdefault(factor, f"c{len(classes)}")
        terms = {n: c for n, c in base.items() if n not in flags}
        place = {n: f"x{i}" for i, n in enumerate(terms)}
        parts = tuple((classes[flags[n][0]], flags[n][1]) if n in flags else place[n] for n in base)
    rows = df.select(
        *keys,
        *keep,
        (F.lit(1.0) if weight is None else as_col(weight).cast("double")).alias("w"),
        as_col(y).cast("double").alias("y"),
        *(c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values())),
        *(F.col(c).alias(name) for c, name in classes.items()),
        *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(factors)),
        *(() if factors else (F.lit("all").alias("f0"),)),
    ).na.drop("any")
    return Design(rows, tuple(keys), names, tuple(factors) or ("(intercept)",), layout and tuple(layout), parts)


@contextmanager
def plain_plans(df: DataFrame) -> Iterator[None]:
    """Inside, the optimizer does not derive constraints from every pair of a wide model's terms.

    That takes it minutes and changes neither plan nor result. Nor are the terms put
    into one method too long for the JVM to compile, which costs a row ten times as
    much. The session's own settings are back afterwards; whatever is planned inside
    must also run inside.
    """
    conf = df.sparkSession.conf
    before = {name: conf.get(name) for name in PLANNING}
    for name, value in PLANNING.items():
        conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            conf.set(name, value)


@dataclass(frozen=True)
class Shape:
    """How a design is solved: the widest factor and its buckets (0: all in one task), or by gradients, or on tables."""

    wide: int | None = None
    buckets: int = 0
    iterate: bool = False
    tables: bool = False


def level_counts(d: Design) -> list[int]:
    """The number of levels of each factor over all keys, approximately, in one pass."""
    return [int(n) for n in d.rows.agg(*(F.approx_count_distinct(f"f{i}") for i in range(len(d.factors)))).first()]


def shape_of(
    d: Design, max_levels: int = MAX_LEVELS, rest_levels: int = REST_LEVELS, max_pairs: int = MAX_PAIRS,
    counts: list[int] | None = None,
) -> Shape:
    """All ways give the same results, so an approximate count may decide."""
    counts = level_counts(d) if counts is None else counts
    if sum(counts) <= max_levels:
        return Shape()
    wide = max(range(len(counts)), key=counts.__getitem__)
    if sum(counts) - counts[wide] > rest_levels:
        m = len(counts)
        pairs = [F.approx_count_distinct(F.struct(f"f{i}", f"f{j}")) for i in range(m) for j in range(i + 1, m)]
        return Shape(iterate=True, tables=sum(d.rows.agg(*pairs).first()) > max_pairs)
    return Shape(wide, -(-counts[wide] // BUCKET_LEVELS))


def normal_sums(
    d: Design, extra: dict[str, Column] | None = None, z: str = "y", w: str = "w", shape: Shape = Shape()
) -> DataFrame:
    """The weighted sums of a design as states: keys, ``__group``, ``__bucket``, ``__state``."""
    rows = d.rows.withColumns(extra) if extra else d.rows
    return states(rows, plan_of(d, tuple(extra or ()), z, w, shape))


def plan_of(d: Design, extra: tuple[str, ...] = (), z: str = "y", w: str = "w", shape: Shape = Shape()) -> Plan:
    """What a pass over a design's rows collects."""
    return Plan(
        d.keys, (z, *d.numbers), tuple(f"f{i}" for i in range(len(d.factors))), w,
        extra, wide=shape.wide, buckets=max(shape.buckets, 1), layout=d.layout,
    )


def _pseudo_inverse(matrix: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Pseudo-inverse and rank, judged against the levels' own weights.

    A level that another factor determines leaves only rounding noise on the
    diagonal, so the diagonal itself would be no measure.
    """
    if not len(matrix):
        return matrix, 0
    scale = np.sqrt(np.maximum(weights, 1e-300))
    values, vectors = np.linalg.eigh(matrix / np.outer(scale, scale))
    keep = values > 1e-10
    vectors = vectors[:, keep] / scale[:, None]
    return (vectors / values[keep]) @ vectors.T, int(keep.sum())


def _independent(cross: np.ndarray, raw: np.ndarray) -> list[int]:
    """Columns not explained by the factors and the columns before them."""
    kept: list[int] = []
    for j in range(len(cross)):
        left = cross[j, j]
        if kept:
            block = cross[np.ix_(kept, kept)]
            left -= cross[j, kept] @ np.linalg.lstsq(block, cross[kept, j], rcond=None)[0]
        if left > COLLINEAR * max(raw[j], 1e-300):
            kept.append(j)
    return kept


@dataclass
class System:
    """The normal equations of one key and replicate, the widest factor eliminated."""

    names: list[list[str]]  # levels of each other factor (the widest: none)
    weights: np.ndarray  # of those levels
    matrix: np.ndarray
    right: np.ndarray  # levels x columns
    cross: np.ndarray  # columns x columns
    raw: np.ndarray  # the diagonal before elimination
    total: np.ndarray  # sum of each column over all rows, weighted
    eliminated: int = 0


def system_of(state: State, g: int, wide: int) -> System:
    """All but the widest factor of a state, for one replicate; levels it never drew are left out."""
    m, p = state.m, state.p
    others = [i for i in range(m) if i != wide]
    names, place, sums, weights, size = [[] for _ in range(m)], [None] * m, [], [], 0
    for i in others:
        own = state.sums[i][:, g]
        there = own[:, 0] > 0
        place[i] = np.where(there, size + np.cumsum(there) - 1, -1)
        listed = list(state.levels[i])
        names[i] = [listed[k] for k in np.flatnonzero(there).tolist()]
        sums.append(own[there, 1:])
        weights.append(own[there, 0])
        size += int(there.sum())
    matrix = np.zeros((size, size))
    weight = np.concatenate(weights) if weights else np.zeros(0)
    matrix[np.arange(size), np.arange(size)] = weight
    for i in others:
        for j in (j for j in others if j > i):
            a, b, values = state.pair(i, j)
            a, b, v = place[i][a], place[j][b], values[:, g]
            keep = v > 0
            matrix[a[keep], b[keep]] = v[keep]
            matrix[b[keep], a[keep]] = v[keep]
    right = np.vstack(sums) if sums else np.zeros((0, p))
    cross = (state.cross[g] + state.cross[g].T) / 2
    return System(names, weight, matrix, right, cross.copy(), np.diag(cross).copy(), np.zeros(p))


def wide_block(state: State, g: int, wide: int, at: Callable[[int, np.ndarray], np.ndarray], size: int):
    """Levels of the widest factor, their weights, sums and joint weights with the ``size`` other levels.

    ``at`` gives the places of another factor's levels (by their numbers in the state) in the system.
    """
    own = state.sums[wide][:, g]
    there = own[:, 0] > 0
    row = np.where(there, np.cumsum(there) - 1, -1)
    joint = np.zeros((int(there.sum()), size))
    for i in (i for i in range(state.m) if i != wide):
        a, b, values = state.pair(min(i, wide), max(i, wide))
        big, other = (a, b) if wide < i else (b, a)
        keep = values[:, g] > 0
        joint[row[big[keep]], at(i, other[keep])] = values[keep, g]
    listed = list(state.levels[wide])
    return [listed[k] for k in np.flatnonzero(there).tolist()], own[there, 0], own[there, 1:], joint


def eliminate(system: System, weights: np.ndarray, sums: np.ndarray, joint: np.ndarray) -> None:
    """Takes levels of the widest factor out of the equations."""
    scaled = joint / weights[:, None]
    system.matrix -= joint.T @ scaled
    system.right -= scaled.T @ sums
    system.cross -= sums.T @ (sums / weights[:, None])
    system.total += sums.sum(axis=0)
    system.eliminated += len(weights)


def _ridge_solution(matrix: np.ndarray, weights: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A solution of consistent equations without their rank: a small ridge, taken back by refinement."""
    if not len(matrix):
        return right
    scale = np.sqrt(weights)
    scaled = matrix / np.outer(scale, scale)
    b = right / scale[:, None]
    inverse = np.linalg.inv(scaled + RIDGE * np.eye(len(scaled)))
    x = inverse @ b
    for _ in range(3):
        x += inverse @ (b - scaled @ x)
    return x / scale[:, None]


@dataclass
class Solved:
    effects: np.ndarray  # of the other factors' levels, by column
    beta: np.ndarray  # by term, zero where left out
    rows: list[tuple]  # COEF, FIT and TOTALS rows


def solved_system(system: System, totals: np.ndarray, terms: Sequence[str], errors: bool = True) -> Solved:
    """Coefficients and fit figures; ``errors`` asks for the rank and all that rests on it."""
    if errors:
        inverse, rank = _pseudo_inverse(system.matrix, system.weights)
        effects = inverse @ system.right
    else:
        rank, effects = 0, _ridge_solution(system.matrix, system.weights, system.right)
    within = system.cross - system.right.T @ effects
    return _coefficients(within, system.raw, system.eliminated + rank, system.total[0], totals, terms, effects, errors)


def _coefficients(
    within: np.ndarray, raw: np.ndarray, absorbed: float, sum_y: float, totals: np.ndarray, terms: Sequence[str],
    effects: np.ndarray, errors: bool = True,
) -> Solved:
    """The model of the terms once the level effects are out of the cross-products."""
    n_rows, sum_w = totals[0], totals[1]
    kept = _independent(within[1:, 1:], raw[1:])
    chosen = [k + 1 for k in kept]
    block = within[np.ix_(chosen, chosen)]
    own = np.linalg.solve(block, within[chosen, 0]) if kept else np.zeros(0)
    beta = np.zeros(len(terms))
    beta[kept] = own
    if not errors:
        return Solved(effects, beta, [(COEF, terms[k], None, float(beta[k]), None, None) for k in kept])
    rss = max(within[0, 0] - (own @ within[chosen, 0] if kept else 0.0), 0.0)
    df_resid = max(n_rows - absorbed - len(kept), 1.0)
    bread = np.linalg.inv(block) if kept else np.zeros((0, 0))
    sigma2 = rss / df_resid
    out = []
    for pos, k in enumerate(kept):
        row = np.zeros(len(terms))
        row[kept] = bread[pos]
        error = float(math.sqrt(max(sigma2 * bread[pos, pos], 0.0)))
        out.append((COEF, terms[k], None, float(own[pos]), error, row.tolist()))
    figures = {
        "n": n_rows,
        "weight": sum_w,
        "rss": rss,
        "absorbed": absorbed,
        "n_terms": len(kept),
        "df_resid": df_resid,
        "sigma2": sigma2,
        "sst": raw[0] - sum_y**2 / sum_w,
    }
    out += [(FIT, name, None, float(value), None, None) for name, value in figures.items()]
    out += [(TOTALS, str(i), None, float(value), None, None) for i, value in enumerate(totals[2:])]
    return Solved(effects, beta, out)


def level_rows(factor: int, names: Sequence[str], effects: np.ndarray, beta: np.ndarray) -> list[tuple]:
    own = effects[:, 0] - effects[:, 1:] @ beta
    return [
        (LEVEL, str(factor), name, float(value), None, vector.tolist())
        for name, value, vector in zip(names, own, effects, strict=True)
    ]


def solve_state(state: State, g: int, terms: Sequence[str], errors: bool = True) -> list[tuple]:
    """All solution rows of one replicate of a whole state."""
    counts = [int((s[:, g, 0] > 0).sum()) for s in state.sums]
    wide = max(range(state.m), key=counts.__getitem__)
    system = system_of(state, g, wide)
    place, size = {}, 0
    for i in (i for i in range(state.m) if i != wide):
        there = state.sums[i][:, g, 0] > 0
        place[i] = np.where(there, size + np.cumsum(there) - 1, -1)
        size += int(there.sum())
    names, weights, sums, joint = wide_block(state, g, wide, lambda i, codes: place[i][codes], size)
    eliminate(system, weights, sums, joint)
    found = solved_system(system, state.totals[g], terms, errors)
    if not errors:
        return found.rows
    out, at = list(found.rows), 0
    for i in range(state.m):
        if i == wide:
            out += level_rows(i, names, (sums - joint @ found.effects) / weights[:, None], found.beta)
        else:
            out += level_rows(i, system.names[i], found.effects[at : at + len(system.names[i])], found.beta)
            at += len(system.names[i])
    return out


def gradient_solution(state: State, terms: Sequence[str]) -> list[tuple]:
    """All solution rows of a whole state without a dense matrix."""
    from moodgrid.plans.sparse import Links, null_dimension

    links = Links(state)
    right = np.vstack([s[:, 0, 1:] for s in state.sums])[links.there]
    effects = links.solve(right)
    cross = (state.cross[0] + state.cross[0].T) / 2
    within = cross - right.T @ effects
    sum_y = state.sums[0][:, 0, 1].sum()
    rank = null_dimension(links)
    found = _coefficients((within + within.T) / 2, np.diag(cross).copy(), rank, sum_y, state.totals[0], terms, effects)
    out, at = list(found.rows), 0
    for i, names in enumerate(links.names):
        out += level_rows(i, names, effects[at : at + len(names)], found.beta)
        at += len(names)
    return out


def _rows_out(head: list, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([v] * len(rows), f.type) for v, f in zip(head, schema, strict=False)]
    body = list(zip(*rows, strict=True)) if rows else [()] * (len(schema) - len(head))
    columns += [pa.array(list(c), f.type) for c, f in zip(body, list(schema)[len(head) :], strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _schema(d: Design, *more: str) -> str:
    types = dict(d.rows.dtypes)
    return ", ".join([*(f"`{k}` {types[k]}" for k in d.keys), *more, SOLUTION])


def solve(d: Design, sums: DataFrame, shape: Shape = Shape(), errors: bool = True) -> DataFrame:
    """Solve every key's system in the executors."""
    if shape.wide is not None:
        return _solve_wide(d, sums, shape.wide)
    n, terms = len(d.keys), d.terms
    schema = _schema(d)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                head = [batch.column(c)[i].as_py() for c in range(n)]
                state = State.unpacked(batch.column(n + 2)[i].as_py())
                rows = gradient_solution(state, terms) if shape.iterate else solve_state(state, 0, terms, errors)
                yield _rows_out(head, rows, arrow)

    return sums.mapInArrow(run, schema)


def _reduced(state: State, wide: int) -> System:
    """A bucket's own levels of the wide factor, eliminated from an otherwise empty system."""
    p = state.p
    names = [[] if i == wide else list(state.levels[i]) for i in range(state.m)]
    starts = np.cumsum([0, *(len(x) for x in names)])
    size, system = int(starts[-1]), _empty(names, p)
    _, weights, sums, joint = wide_block(state, 0, wide, lambda i, codes: starts[i] + codes, size)
    eliminate(system, weights, sums, joint)
    return system


def _empty(names: list[list[str]], p: int) -> System:
    size = sum(len(x) for x in names)
    return System(names, np.zeros(size), np.zeros((size, size)), np.zeros((size, p)), np.zeros((p, p)), np.zeros(p), np.zeros(p))


def _placed(system: System, where: list[dict[str, int]], part: System) -> None:
    """Adds what a part eliminated to a system that has all its levels."""
    index = np.concatenate([np.array([where[i][x] for x in names], np.int64) for i, names in enumerate(part.names)])
    system.matrix[np.ix_(index, index)] += part.matrix
    system.right[index] += part.right
    system.cross += part.cross
    system.total += part.total
    system.eliminated += part.eliminated


def _combined(one: System, two: System) -> System:
    """The sum of two parts over the levels of both."""
    out = _empty([list(dict.fromkeys([*a, *b])) for a, b in zip(one.names, two.names, strict=True)], len(one.cross))
    where = _places(out)
    for part in (one, two):
        _placed(out, where, part)
    return out


def _solve_wide(d: Design, sums: DataFrame, wide: int) -> DataFrame:
    """The solution when the levels of one factor lie in buckets.

    Every bucket eliminates its levels; the system of the others meets in one task;
    the effects of the wide factor follow from its solution, bucket by bucket.
    """
    keys, n, terms = list(d.keys), len(d.keys), d.terms
    held = cut_lineage(sums)
    head_types = ", ".join(f"`{k}` {t}" for k, t in dict(d.rows.dtypes).items() if k in keys)
    reduced_schema = ", ".join(x for x in (head_types, "__bucket int, __part binary") if x)
    reduced_arrow = to_arrow_schema(_parse_datatype_string(reduced_schema))
    schema = _schema(d)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rests as they are; of the buckets that lie in this task one system a key, so its size does not grow with them."""

        def out(head: tuple, bucket: int, part: State | System) -> pa.RecordBatch:
            values = (*head, bucket, zlib.compress(pickle.dumps(part, protocol=5), 1))
            columns = [pa.array([v], f.type) for v, f in zip(values, reduced_arrow, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=reduced_arrow)

        at, total = None, None
        for batch in batches:
            for i in range(len(batch)):
                head = tuple(batch.column(c)[i].as_py() for c in range(n))
                bucket, state = batch.column(n + 1)[i].as_py(), State.unpacked(batch.column(n + 2)[i].as_py())
                if bucket == REST:
                    yield out(head, REST, state)
                    continue
                part = _reduced(state, wide)
                if head != at and total is not None:
                    yield out(at, 0, total)
                at, total = head, part if head != at or total is None else _combined(total, part)
        if total is not None:
            yield out(at, 0, total)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest, system, where = None, None, None, []

        def out() -> pa.RecordBatch:
            found = solved_system(system, rest.totals[0], terms)
            rows, first = list(found.rows), 0
            for i, names in enumerate(system.names):
                rows += level_rows(i, names, found.effects[first : first + len(names)], found.beta)
                first += len(names)
            return _rows_out(list(at), rows, arrow)

        for batch in batches:
            for i in range(len(batch)):
                key = tuple(batch.column(c)[i].as_py() for c in range(n))
                part = pickle.loads(zlib.decompress(batch.column(n + 1)[i].as_py()))
                if key != at:
                    if at is not None:
                        yield out()
                    # A key's rest comes before its buckets.
                    at, rest, system = key, part, system_of(part, 0, wide)
                    where = _places(system)
                else:
                    _placed(system, where, part)
        if at is not None:
            yield out()

    parts = held.mapInArrow(reduce, reduced_schema)
    cores = d.rows.sparkSession.sparkContext.defaultParallelism
    parts = parts.repartition(4 * cores, *keys) if keys else parts.repartition(1)
    parts = parts.sortWithinPartitions(*keys, "__bucket")
    solution = cut_lineage(parts.mapInArrow(finish, schema))

    # Effects of the wide factor: each bucket meets its key's solution.
    known = solution.filter(F.col("kind").isin(LEVEL, COEF)).groupBy(*keys).agg(
        F.collect_list(F.struct("kind", "term", "level", "estimate", "vec")).alias("__solution")
    )
    buckets = held.filter(F.col("__bucket") != REST)
    if keys:
        met = buckets.join(known, keys).select(*keys, "__state", "__solution")
    else:
        met = buckets.select("__state").withColumn("__solution", known.select("__solution").scalar())

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                head = [batch.column(c)[i].as_py() for c in range(n)]
                state = State.unpacked(batch.column(n)[i].as_py())
                rows = batch.column(n + 1)[i].as_py()
                beta = np.zeros(len(terms))
                for r in rows:
                    if r["kind"] == COEF:
                        beta[terms.index(r["term"])] = r["estimate"]
                own: dict[tuple[int, str], list[float]] = {(int(r["term"]), r["level"]): r["vec"] for r in rows if r["kind"] == LEVEL}
                names = [[] if f == wide else list(state.levels[f]) for f in range(state.m)]
                starts = np.cumsum([0, *(len(x) for x in names)])
                table = np.array([own[f, x] for f, listed in enumerate(names) for x in listed]).reshape(-1, state.p)
                big, weights, sums, joint = wide_block(state, 0, wide, lambda f, codes: starts[f] + codes, int(starts[-1]))
                yield _rows_out(head, level_rows(wide, big, (sums - joint @ table) / weights[:, None], beta), arrow)

    return solution.unionByName(met.mapInArrow(effects, schema))


def tidy(solution: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """term, estimate, std_error, statistic, p_value per key (normal tail)."""
    z = F.abs(F.col("estimate") / F.col("std_error"))
    return solution.filter(F.col("kind") == COEF).select(
        *keys,
        "term",
        "estimate",
        "std_error",
        (F.col("estimate") / F.col("std_error")).alias("statistic"),
        two_sided_p(z).alias("p_value"),
    )


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    x = z / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    # The polynomial's weights, highest power first.
    for weight in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(weight)
    return F.least(poly * t * F.exp(-x * x), F.lit(1.0))


def figures(solution: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row of fit figures per key, with the Gaussian AIC."""
    names = ("n", "weight", "rss", "absorbed", "n_terms", "df_resid", "sigma2", "sst")
    wide = solution.filter(F.col("kind") == FIT).groupBy(*keys).agg(
        *(F.max(F.when(F.col("term") == n, F.col("estimate"))).alias(n) for n in names)
    )
    n = F.col("n")
    log_lik = -n / 2 * (F.log(F.lit(2 * math.pi)) + F.log(F.col("rss") / n) + F.lit(1.0))
    return wide.withColumn("aic", F.lit(-2.0) * log_lik + F.lit(2.0) * (F.col("absorbed") + F.col("n_terms")))


def fe_ols(
    df: DataFrame,
    y: str | Column,
    terms: dict[str, Column],
    factors: Sequence[str] = (),
    weight: str | Column | None = None,
    keys: Sequence[str] = (),
    max_levels: int = MAX_LEVELS,
    rest_levels: int = REST_LEVELS,
    max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """Fit one model per key; returns the solution rows (see ``tidy``)."""
    d = design(df, y, terms, factors, weight, keys, compact=True)
    return fitted(d, max_levels, rest_levels, max_pairs)


def fitted(
    d: Design, max_levels: int = MAX_LEVELS, rest_levels: int = REST_LEVELS, max_pairs: int = MAX_PAIRS
) -> DataFrame:
    """Solution rows of a design, by the way that its number of levels asks for.

    They are written once, as most uses read them several times.
    """
    with plain_plans(d.rows):
        return cut_lineage(solution_of(d, shape_of(d, max_levels, rest_levels, max_pairs)))


def nested_fits(
    df: DataFrame, y: str | Column, forms: Sequence[dict[str, Column]], factors: Sequence[str], keys: Sequence[str] = (),
    max_levels: int = MAX_LEVELS, rest_levels: int = REST_LEVELS,
) -> list[DataFrame]:
    """``fe_ols`` of several forms; terms of one name are the same column.

    One pass over the rows serves all of them where they leave out the same incomplete
    rows and the level effects need no gradients; else each form has its own.
    """
    union = Terms(*forms)
    whole = lambda terms: F.forall(F.array(*(c.cast("double") for c in terms.values())), lambda v: v.isNotNull() & ~F.isnan(v))
    with plain_plans(df):
        given = [F.col(c) if isinstance(c, str) else c for c in (y, *factors, *keys)]
        flat = df.select(*(c.alias(f"__c{i}") for i, c in enumerate(given)), *(whole(terms).alias(f"__{i}") for i, terms in enumerate(forms)))
        usable = flat.na.drop("any")
        flags = [F.col(f"__{i}") for i in range(len(forms))]
        apart = usable.filter(F.greatest(*flags) & ~F.least(*flags)) if len(forms) > 1 else usable.limit(0)
        same = apart.isEmpty()
        d = design(df, y, union, factors, None, keys, compact=True)
        shape = shape_of(d, max_levels, rest_levels) if same else None
        if not same or shape.iterate:
            return [fe_ols(df, y, terms, factors, None, keys, max_levels, rest_levels) for terms in forms]
        sums = cut_lineage(normal_sums(d, shape=shape))
        place = {name: k + 1 for k, name in enumerate(union)}
        out = []
        for terms in forms:
            own = sums.mapInArrow(_columns_of(len(d.keys) + 2, [0, *(place[t] for t in terms)]), sums.schema)
            out.append(cut_lineage(solve(Design(d.rows, d.keys, tuple(terms), d.factors), own, shape)))
        return out


def _columns_of(state: int, at: list[int]):
    """Rows of states with some of their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part = State.unpacked(batch.column(state)[i].as_py()).some_columns(at).packed()
                columns = [batch.column(c).slice(i, 1) for c in range(state)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([part], batch.schema.field(state).type)], schema=batch.schema)

    return run


def solution_of(
    d: Design, shape: Shape, extra: dict[str, Column] | None = None, z: str = "y", w: str = "w"
) -> DataFrame:
    """Solution rows of a design in a given way."""
    if shape.tables:
        from moodgrid.plans.sparse import iterated

        return iterated(d.whole(), extra, z, w)
    return solve(d, normal_sums(d, extra, z, w, shape), shape)


def bootstrap_ols(
    df: DataFrame,
    y: str | Column,
    terms: dict[str, Column],
    factors: Sequence[str],
    ids: Sequence[str],
    replicates: int = 80,
    seed: int = 1,
    first: int = 1,
    max_levels: int = MAX_LEVELS,
    rest_levels: int = REST_LEVELS,
) -> DataFrame:
    """replicate, term, estimate of ``fe_ols`` on resampled rows.

    The rows are read once. They meet by levels of the widest factor, spread where one
    is hot, so that few pairs of levels occur in two tasks; a task draws the weights of
    all replicates for a batch of rows at once. ``GROUP`` replicates travel together.
    A wide factor's levels lie in buckets; the buckets of a group come one after another
    to the task that solves its replicates, which eliminates each as it comes. Designs
    with two wide factors take the replicate as a key of ``fe_ols``.
    """
    one, two = seeds(ids, seed)
    seeded = df.withColumns({"__one": one, "__two": two})
    of = lambda rows: design(rows, y, terms, factors, keep=("__one", "__two"), compact=True)
    with plain_plans(df):
        counts = level_counts(of(seeded))
    wide = max(range(len(counts)), key=counts.__getitem__)
    dealt = sum(counts) > max_levels
    if dealt and sum(counts) - counts[wide] > rest_levels:
        drawn = with_replicates(df, ids, replicates, seed, first)
        solution = fe_ols(drawn, y, terms, factors, "weight", ["replicate"], max_levels, rest_levels)
        return solution.filter(F.col("kind") == COEF).select("replicate", "term", "estimate")
    # The rows are dealt before the terms are formed, which are many times as many as the columns they need.
    usable = seeded.na.drop("any", subset=list(factors))
    d = of(usable.hint("rebalance", factors[wide]) if factors else usable)
    rows = d.rows
    plan = Plan(
        (), ("y", *d.numbers), tuple(f"f{i}" for i in range(len(d.factors))), "w", layout=d.layout,
        draw=partial(draws, first=first, replicates=replicates), seeds=("__one", "__two"), replicates=replicates, group=GROUP,
        wide=wide if dealt else None, buckets=-(-counts[wide] // BUCKET_LEVELS) if dealt else 1,
    )
    names = d.terms
    schema = "replicate int, term string, estimate double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def out(group: int, g: int, rows: list[tuple]) -> pa.RecordBatch:
        return _rows_out([], [(first + group * GROUP + g, r[1], r[3]) for r in rows], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                group, state = batch.column(0)[i].as_py(), State.unpacked(batch.column(2)[i].as_py())
                for g in range(state.g):
                    yield out(group, g, solve_state(state, g, names, errors=False))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest, systems, places = None, None, [], []

        def solved() -> Iterator[pa.RecordBatch]:
            for g, system in enumerate(systems):
                yield out(at, g, solved_system(system, rest.totals[g], names, errors=False).rows)

        for batch in batches:
            for i in range(len(batch)):
                group, bucket = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                state = State.unpacked(batch.column(2)[i].as_py())
                if bucket == REST:
                    # A group's rest comes before its buckets.
                    yield from solved()
                    at, rest = group, state
                    systems = [system_of(rest, g, wide) for g in range(rest.g)]
                    places = [_places(system) for system in systems]
                    continue
                for g, system in enumerate(systems):
                    # Levels that a replicate never drew have no place and no joint weight.
                    own = [np.array([places[g][f].get(x, -1) for x in listed], np.int64) for f, listed in enumerate(state.levels)]
                    _, weights, sums, joint = wide_block(state, g, wide, lambda f, codes: own[f][codes], len(system.weights))  # noqa: B023
                    eliminate(system, weights, sums, joint)
        yield from solved()

    with plain_plans(df):
        found = states(rows, plan)
        if not dealt:
            return cut_lineage(found.mapInArrow(run, schema))
        groups = found.repartitionById(-(-replicates // GROUP), F.col("__group")).sortWithinPartitions("__group", "__bucket")
        return cut_lineage(groups.mapInArrow(finish, schema))


def _places(system: System) -> list[dict[str, int]]:
    """By factor and level the row of the system."""
    starts = np.cumsum([0, *(len(x) for x in system.names)])
    return [{x: int(starts[f]) + k for k, x in enumerate(names)} for f, names in enumerate(system.names)]


def demeaned(d: Design, max_levels: int = MAX_LEVELS, rest_levels: int = REST_LEVELS) -> Design:
    """The design with all level effects taken out of y and the terms; the rows are read twice."""
    keys = list(d.keys)
    solution = fitted(d, max_levels, rest_levels)
    rows = d.rows
    for i in range(len(d.factors)):
        effects = solution.filter((F.col("kind") == LEVEL) & (F.col("term") == str(i))).select(
            *keys, F.col("level").alias(f"f{i}"), F.col("vec").alias(f"e{i}")
        )
        rows = lookup_join(rows, effects, [*keys, f"f{i}"], "inner")
    gone = lambda j: sum((F.col(f"e{i}")[j] for i in range(len(d.factors))), F.lit(0.0))
    values = ["y", *(f"x{i}" for i in range(len(d.terms)))]
    flat = rows.select(*keys, "w", *((F.col(v) - gone(j)).alias(v) for j, v in enumerate(values)), F.lit("all").alias("f0"))
    return Design(flat, d.keys, d.terms, ("(absorbed)",))


def clustered(
    df: DataFrame,
    y: str | Column,
    terms: dict[str, Column],
    factors: Sequence[str],
    cluster: str,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """``fe_ols`` with standard errors clustered on ``cluster``.

    A second pass removes the level effects from y and X, which the first
    solution provides, and folds the scores per cluster.
    """
    d = design(df, y, terms, factors, keep=[c for c in (cluster,) if c not in factors])
    solution = fitted(d, max_levels)
    k = len(terms)
    coefs = {r["term"]: r for r in solution.filter(F.col("kind") == COEF).collect()}
    fit = figures(solution).first()
    beta = [coefs[t]["estimate"] if t in coefs else 0.0 for t in terms]
    rows = d.rows
    for i in range(len(d.factors)):
        effects = solution.filter((F.col("kind") == LEVEL) & (F.col("term") == str(i))).select(
            F.col("level").alias(f"f{i}"), F.col("vec").alias(f"e{i}")
        )
        rows = lookup_join(rows, effects, [f"f{i}"], "inner")
    clean = [F.col(c) - sum((F.col(f"e{i}")[j] for i in range(len(d.factors))), F.lit(0.0)) for j, c in enumerate(["y", *(f"x{i}" for i in range(k))])]
    error = clean[0] - sum((F.lit(b) * c for b, c in zip(beta, clean[1:], strict=True)), F.lit(0.0))
    group = F.col(f"f{list(factors).index(cluster)}") if cluster in factors else F.col(cluster)
    scores = rows.groupBy(group.alias("c")).agg(
        *(F.sum(F.col("w") * error * clean[j + 1]).alias(f"s{j}") for j in range(k))
    )
    meat_row = scores.agg(
        F.count(F.lit(1)).alias("g"),
        *(F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"m{a}_{b}") for a in range(k) for b in range(a, k)),
    ).first()
    meat = np.zeros((k, k))
    for a in range(k):
        for b in range(a, k):
            meat[a, b] = meat[b, a] = meat_row[f"m{a}_{b}"]
    bread = np.array([coefs[t]["vec"] if t in coefs else [0.0] * k for t in terms])
    g = meat_row["g"]
    small = g / max(g - 1, 1) * (fit["n"] - 1) / fit["df_resid"]
    variance = np.diag(bread @ meat @ bread) * small
    out = [
        (t, float(b), float(math.sqrt(max(v, 0.0)))) for t, b, v in zip(terms, beta, variance, strict=True) if t in coefs
    ]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, std_error double")
