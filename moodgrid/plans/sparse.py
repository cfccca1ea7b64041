"""Level effects by conjugate gradients over the joint weights of pairs of levels.

For designs with two or more factors too wide for a dense system. The rows are
folded once; every step then only meets the pairs: in numpy where a key's pairs fit
a task (``Links``), else as joins of written tables of levels and pairs, where keys
make the system block-diagonal and each column has its own step lengths.

The rank follows from the null space: for random columns v and x with G x = G v the
differences v - x lie in it and span it once there are more columns than it has
dimensions. Columns are added in blocks until their own rank falls short of their
number. Factors whose levels are unions of another one's levels are left out first,
they add nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from moodgrid.plans.accumulate import Plan, State, partial_states
from moodgrid.session import cut_lineage

TOLERANCE = 1e-12
ROUNDS = 2_000
RANDOM_COLUMNS = 32
CELLS = 8 << 20


def nested(single: set[tuple[int, int]], m: int) -> set[int]:
    """Factors that another one determines; ``single`` holds (i, j) where each level of i meets one of j."""
    gone: set[int] = set()
    for j in range(m):
        if any((i, j) in single and i not in gone and ((j, i) not in single or i < j) for i in range(m) if i != j):
            gone.add(j)
    return gone


class Links:
    """The system of a state's levels as pairs; levels without weight are left out, as are the factors in ``without``."""

    def __init__(self, state: State, without: set[int] = frozenset()):
        self.state, self.kept = state, [i for i in range(state.m) if i not in without]
        own = [state.sums[i][:, 0, 0] if i in self.kept else np.zeros(len(state.sums[i])) for i in range(state.m)]
        self.there = np.concatenate([w > 0 for w in own])
        self.weights = np.concatenate(own)[self.there]
        number = np.cumsum(self.there) - 1
        starts = np.cumsum([0, *(len(w) for w in own)])
        self.names = [[n for n, w in zip(state.levels[i], own[i], strict=True) if w > 0] for i in range(state.m)]
        self.single: set[tuple[int, int]] = set()
        sides = []
        for i in self.kept:
            for j in (j for j in self.kept if j > i):
                a, b, values = state.pair(i, j)
                keep = values[:, 0] > 0
                a, b = number[starts[i] + a[keep]], number[starts[j] + b[keep]]
                for (x, left), (y, right) in (((i, a), (j, b)), ((j, b), (i, a))):
                    if len(np.unique(left)) == len(left):
                        self.single.add((x, y))
                    sides.append((left, right, values[keep, 0]))
        to, sent, joint = (np.concatenate(s) for s in zip(*sides, strict=True)) if sides else (np.empty(0, np.int64),) * 3
        order = np.argsort(to, kind="stable")
        self.sent, self.joint = sent[order], joint[order].astype(float)
        to = to[order]
        self.first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.empty(0, np.int64)
        self.to = to[self.first]

    def times(self, x: np.ndarray) -> np.ndarray:
        out = self.weights[:, None] * x
        # Some columns at a time: the gathered rows are as many as the pairs.
        step = max(1, CELLS // max(len(self.sent), 1))
        for low in range(0, x.shape[1], step) if len(self.sent) else ():
            part = x[:, low : low + step][self.sent] * self.joint[:, None]
            out[self.to, low : low + step] += np.add.reduceat(part, self.first, axis=0)
        return out

    def solve(self, right: np.ndarray) -> np.ndarray:
        """x with G x = each column of ``right``, which lies in the range of G."""
        scale = self.weights[:, None]
        x, r = np.zeros_like(right), right.copy()
        p = r / scale
        old = first = (r * r / scale).sum(axis=0)
        goal = first * TOLERANCE**2
        for _ in range(ROUNDS):
            if (old <= goal).all():
                return x
            q = self.times(p)
            step = (p * q).sum(axis=0)
            step = np.where((step > 0) & (old > goal), old / np.where(step > 0, step, 1.0), 0.0)
            x += step * p
            r -= step * q
            new = (r * r / scale).sum(axis=0)
            p = r / scale + np.where(old > 0, new / np.where(old > 0, old, 1.0), 0.0) * p
            old = new
        raise RuntimeError("the level effects did not settle")


def null_dimension(links: Links) -> int:
    """The number of independent level effects, from the null space of the system."""
    own = Links(links.state, nested(links.single, links.state.m))
    size, rng, null = len(own.weights), np.random.default_rng(0), np.zeros((len(own.weights), 0))
    root = np.sqrt(own.weights)[:, None]
    while True:
        v = rng.uniform(-1, 1, (size, RANDOM_COLUMNS)) / root
        null = np.column_stack((null, (v - own.solve(own.times(v))) * root))
        rank = int((np.linalg.eigvalsh(null.T @ null) > 1e-7).sum())
        if rank < null.shape[1]:
            return size - rank


def _attached(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one row of each key's table at all rows of the key."""
    if keys:
        return rows.join(table, list(keys))
    one = table.select(F.struct(*table.columns).alias("s")).scalar()
    return rows.withColumn("__one", one).select("*", "__one.*").drop("__one")


def _typed(d) -> str:
    return "".join(f"`{k}` {t}, " for k, t in d.rows.dtypes if k in d.keys)


def _unrolled(n: int, schema: pa.Schema):
    """Rows of partial states: kind 0 what has no levels, 1 the levels, 2 the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(head, kind, i, a, j, b, vec, state=None) -> pa.RecordBatch:
            many = len(vec)
            columns = [pa.array([v] * many, f.type) for v, f in zip(head, schema, strict=False)]
            values = (np.full(many, kind, np.int32), np.full(many, i, np.int32), a, np.full(many, j, np.int32), b)
            columns += [pa.array(v, f.type) for v, f in zip(values, list(schema)[n : n + 5], strict=True)]
            flat = pa.array(np.ascontiguousarray(vec, float).ravel())
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * vec.shape[1], pa.int32()), flat))
            columns.append(pa.array([state] * many, pa.binary()))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for row in range(len(batch)):
                head = [batch.column(c)[row].as_py() for c in range(n)]
                state = State.unpacked(batch.column(n + 2)[row].as_py())
                bare = State(state.p, 0, 1, state.e)
                bare.totals, bare.cross = state.totals, state.cross
                yield out(head, 0, -1, [None], -1, [None], np.zeros((1, 0)), bare.packed())
                for i in range(state.m):
                    yield out(head, 1, i, list(state.levels[i]), -1, [None] * len(state.levels[i]), state.sums[i][:, 0])
                for i, j in state.pairs:
                    a, b, values = state.pair(i, j)
                    first, second = np.array(list(state.levels[i]), object), np.array(list(state.levels[j]), object)
                    yield out(head, 2, i, first[a].tolist(), j, second[b].tolist(), values)

    return run


def level_tables(d, extra: dict[str, Column] | None, z: str, w: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals as packed states, levels with numbers, links between the numbers in both directions."""
    keys, p = list(d.keys), 1 + len(d.terms)
    rows = d.rows.withColumns(extra) if extra else d.rows
    plan = Plan(
        d.keys, (z, *(f"x{i}" for i in range(p - 1))), tuple(f"f{i}" for i in range(len(d.factors))), w, tuple(extra or ())
    )
    found, _ = partial_states(rows, plan)
    schema = f"{_typed(d)}kind int, i int, a string, j int, b string, vec array<double>, state binary"
    unrolled = found.mapInArrow(_unrolled(len(keys), to_arrow_schema(_parse_datatype_string(schema))), schema)
    held = cut_lineage(unrolled)
    totals = held.filter("kind = 0").select(*keys, "state")
    sums = [F.sum(F.col("vec")[c]).alias(name) for c, name in enumerate(["w", *(f"t{c}" for c in range(p))])]
    levels = held.filter("kind = 1").groupBy(*keys, "i", "a").agg(*sums).filter("w > 0")
    levels = cut_lineage(levels.withColumn("id", F.monotonically_increasing_id()))
    pairs = held.filter("kind = 2").groupBy(*keys, "i", "a", "j", "b").agg(F.sum(F.col("vec")[0]).alias("joint"))
    pairs = pairs.filter("joint > 0")
    number = levels.select(*keys, "i", "a", "id")
    one = pairs.join(number.withColumnRenamed("id", "src"), [*keys, "i", "a"])
    two = one.join(number.select(*keys, F.col("i").alias("j"), F.col("a").alias("b"), F.col("id").alias("dst")), [*keys, "j", "b"])
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), F.col("i").alias("from"), F.col("j").alias("to")),
            F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("j").alias("from"), F.col("i").alias("to")),
        )
    )
    links = cut_lineage(two.select("joint", ends.alias("e")).select("e.*", "joint"))
    return totals, levels, links


def product_by_links(links: DataFrame, table: DataFrame, names: Sequence[str], to: Sequence[str]) -> DataFrame:
    """The table with the system's matrix times the named columns; needs ``id`` and ``w``."""
    sent = table.select(F.col("id").alias("src"), *names)
    got = links.join(sent, "src").groupBy("dst").agg(*(F.sum(F.col("joint") * F.col(n)).alias(f"__{n}") for n in names))
    joined = table.join(got.withColumnRenamed("dst", "id"), "id", "left")
    own = {t: F.col("w") * F.col(n) + F.coalesce(f"__{n}", F.lit(0.0)) for n, t in zip(names, to, strict=True)}
    return joined.withColumns(own).drop(*(f"__{n}" for n in names))


def conjugate(levels: DataFrame, links: DataFrame, right: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``id`` and x with G x = b for each named column b of ``levels`` (id, keys, w)."""
    keys, c = list(keys), range(len(right))
    x, r, p, q = ([f"{v}{k}" for k in c] for v in "xrpq")
    norm = lambda name: [F.sum(F.col(r[k]) ** 2 / F.col("w")).alias(f"{name}{k}") for k in c]
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    table = levels.select(
        "id", *keys, "w", *(F.lit(0.0).alias(n) for n in x), *(F.col(b).alias(r[k]) for k, b in enumerate(right)),
        *((F.col(b) / F.col("w")).alias(p[k]) for k, b in enumerate(right)),
    )
    begin = cut_lineage(table.groupBy(*keys).agg(*norm("first")))
    for _ in range(ROUNDS):
        table = cut_lineage(product_by_links(links, table, p, q))
        steps = table.groupBy(*keys).agg(*(F.sum(F.col(p[k]) * F.col(q[k])).alias(f"pq{k}") for k in c), *norm("old"))
        moved = _attached(table, steps, keys)
        moved = moved.withColumns({x[k]: F.col(x[k]) + ratio(f"old{k}", f"pq{k}") * F.col(p[k]) for k in c} | {
            r[k]: F.col(r[k]) - ratio(f"old{k}", f"pq{k}") * F.col(q[k]) for k in c
        }).drop(*(f"pq{k}" for k in c))
        moved = cut_lineage(moved)
        left = moved.groupBy(*keys).agg(*norm("new"))
        worst = _attached(left, begin, keys).agg(
            F.max(F.greatest(*(ratio(f"new{k}", f"first{k}") for k in c), F.lit(0.0)))
        ).first()[0]
        if (worst or 0.0) <= TOLERANCE**2:
            return moved.select("id", *x)
        table = _attached(moved, left, keys).withColumns(
            {p[k]: F.col(r[k]) / F.col("w") + ratio(f"new{k}", f"old{k}") * F.col(p[k]) for k in c}
        ).select("id", *keys, "w", *x, *r, *p)
    raise RuntimeError("the level effects did not settle")


def _products(n: int, left: Sequence[str], right: Sequence[str], schema: pa.Schema):
    """Per key and task the sums of products of two sets of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.column_stack([batch.column(c).to_numpy() for c in names]) for names in (left, right))
            heads = list(zip(*(batch.column(c).to_pylist() for c in range(n)), strict=True)) if n else [()] * len(batch)
            for head in dict.fromkeys(heads):
                at = np.array([h == head for h in heads]) if n else slice(None)
                own = sums.setdefault(head, [np.zeros((len(left), len(right))), 0])
                own[0] += a[at].T @ b[at]
                own[1] += int(at.sum()) if n else len(batch)
        for head, (matrix, many) in sums.items():
            values = (*head, pickle.dumps(matrix, protocol=5), many)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return run


def products(d, table: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """keys, ``matrix`` (packed) and ``rows``: parts that add up."""
    schema = f"{_typed(d)}matrix binary, rows bigint"
    keys = list(d.keys)
    table = table.select(*keys, *dict.fromkeys([*left, *right]))
    table = table.sortWithinPartitions(*keys) if keys else table
    return table.mapInArrow(_products(len(keys), left, right, to_arrow_schema(_parse_datatype_string(schema))), schema)


def rank_of_levels(d, levels: DataFrame, links: DataFrame) -> DataFrame:
    """Per key ``rank``: the number of independent level effects."""
    keys, m = list(d.keys), len(d.factors)
    # Factor j adds nothing where each level of another one meets one of its levels.
    meets = links.groupBy("src", "from", "to").agg(F.count("*").alias("n")).groupBy("from", "to").agg(F.max("n").alias("n"))
    single = {(r["from"], r["to"]) for r in meets.collect() if r["n"] == 1}
    gone = nested(single, m)
    kept = levels.filter(~F.col("i").isin(*gone)) if gone else levels
    joined = links.filter(~F.col("from").isin(*gone) & ~F.col("to").isin(*gone)) if gone else links
    kept, columns = kept.select("id", *keys, "w"), []
    while True:
        # Further random columns; in the scale of the weights all directions are alike.
        fresh = range(len(columns), len(columns) + RANDOM_COLUMNS)
        noise = {f"v{k}": (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 39)) - 1) / F.sqrt("w") for k in fresh}
        names = list(noise)
        mixed = cut_lineage(product_by_links(joined, kept.select("id", *keys, "w").withColumns(noise), names, [f"g{k}" for k in fresh]))
        solved = conjugate(mixed, joined, [f"g{k}" for k in fresh], keys)
        null = mixed.join(solved, "id").select("id", *((F.col(f"v{k}") - F.col(f"x{n}")).alias(f"n{k}") for n, k in enumerate(fresh)))
        kept = cut_lineage(kept.join(null, "id"))
        columns += [f"n{k}" for k in fresh]
        scaled = kept.select(*keys, *((F.col(n) * F.sqrt("w")).alias(n) for n in columns))
        schema = f"{_typed(d)}rank double, full boolean"
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        n, wide = len(keys), len(columns)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, list] = {}
            for batch in batches:
                for row in range(len(batch)):
                    head = tuple(batch.column(c)[row].as_py() for c in range(n))
                    own = sums.setdefault(head, [0.0, 0])
                    own[0] = own[0] + pickle.loads(batch.column(n)[row].as_py())
                    own[1] += batch.column(n + 1)[row].as_py()
            for head, (matrix, many) in sums.items():
                size = int((np.linalg.eigvalsh((matrix + matrix.T) / 2) > 1e-7).sum())
                values = (*head, float(many - size), size == wide)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        parts = products(d, scaled, columns, columns)
        parts = parts.repartition(*keys) if keys else parts.coalesce(1)
        ranks = cut_lineage(parts.mapInArrow(count, schema))
        if ranks.filter("full").isEmpty():
            return ranks.select(*keys, "rank")


def iterated(d, extra: dict[str, Column] | None, z: str, w: str) -> DataFrame:
    """Solution rows of a design; see ``estimation.solution_of``."""
    from moodgrid.plans.estimation import LEVEL, Design, _coefficients, _rows_out, _schema

    # Names of their own for the keys: the tables have many short ones.
    own_names = [f"__key{i}" for i in range(len(d.keys))]
    names = dict(zip(d.keys, own_names, strict=True))
    d = Design(d.rows.withColumnsRenamed(names), tuple(own_names), d.terms, d.factors)
    keys, p, n, terms = list(d.keys), 1 + len(d.terms), len(d.keys), d.terms
    totals, levels, links = level_tables(d, extra, z, w)
    solved = conjugate(levels, links, [f"t{c}" for c in range(p)], keys)
    effects = cut_lineage(levels.join(solved, "id"))
    within = products(d, effects, [f"t{c}" for c in range(p)], [f"x{c}" for c in range(p)])
    rank = rank_of_levels(d, levels, links)
    sum_y = levels.filter("i = 0").groupBy(*keys).agg(F.sum("t0").alias("sum_y"))
    facts = _attached(rank, sum_y, keys)
    parts = _attached(
        totals.select(*keys, F.lit(0).alias("part"), "state").unionByName(
            within.select(*keys, F.lit(1).alias("part"), F.col("matrix").alias("state"))
        ),
        facts, keys,
    ).select(*keys, "part", "state", "rank", "sum_y")
    schema = _schema(d)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for row in range(len(batch)):
                head = tuple(batch.column(c)[row].as_py() for c in range(n))
                part, data, rank, sum_y = (batch.column(n + c)[row].as_py() for c in range(4))
                own = sums.setdefault(head, [None, 0.0, rank, sum_y])
                if part == 1:
                    own[1] = own[1] + pickle.loads(data)
                elif own[0] is None:
                    own[0] = State.unpacked(data)
                else:
                    own[0].merge(State.unpacked(data))
        for head, (state, matrix, rank, sum_y) in sums.items():
            cross = (state.cross[0] + state.cross[0].T) / 2
            inner = cross - (matrix + matrix.T) / 2
            found = _coefficients(inner, np.diag(cross).copy(), rank, sum_y, state.totals[0], terms, np.zeros((0, p)))
            yield _rows_out(list(head), found.rows, arrow)

    parts = parts.repartition(*keys) if keys else parts.coalesce(1)
    fit = cut_lineage(parts.mapInArrow(finish, schema))
    beta = fit.filter("kind = 'coef'").groupBy(*keys).agg(
        *(F.coalesce(F.max(F.when(F.col("term") == t, F.col("estimate"))), F.lit(0.0)).alias(f"b{j}") for j, t in enumerate(terms)),
        F.count(F.lit(1)).alias("__n"),
    )
    own = F.col("x0") - sum((F.col(f"b{j}") * F.col(f"x{j + 1}") for j in range(p - 1)), F.lit(0.0))
    levels_out = _attached(effects, beta, keys).select(
        *keys, F.lit(LEVEL).alias("kind"), F.col("i").cast("string").alias("term"), F.col("a").alias("level"), own.alias("estimate"),
        F.lit(None).cast("double").alias("std_error"), F.array(*(f"x{c}" for c in range(p))).alias("vec"),
    )
    return fit.unionByName(levels_out).withColumnsRenamed({v: k for k, v in names.items()})
