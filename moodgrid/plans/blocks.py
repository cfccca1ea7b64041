"""Rows of a model as packed blocks of numbers, for fits that pass over them many times.

A block holds some rows of one key (and, with a wide factor, of one bucket of its
levels) by column: numbers as they are, factors as small codes with the block's own
list of levels. Rows are read and their strings numbered once; a step of the fit then
meets blocks only. Each is joined with the part of the last solution that it needs: the
coefficients and the effects of the key, and of its bucket's levels of the wide factor.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from moodgrid.plans.accumulate import Alike, Plan, State, _handed, _key_groups, _outgrown, laid_out, merged_states, numbers_of, read

# Cells of a block, and rows at most.
BLOCK_CELLS = 1 << 19
BLOCK_ROWS = 1 << 16
# Blocks' worth of rows that a task gathers before the largest one is handed on.
OPEN_BLOCKS = 16
# Effects that may be sent to every executor.
SENT_LEVELS = 500_000

# The numbers of a block (columns x rows) and the parts of a solution give the linear predictor's sums:
# columns of the fold (outcome first), weights, further sums.
Working = Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _packed(values: np.ndarray, codes: np.ndarray, names: list[list[str]]) -> tuple[int, bytes]:
    """Size and compressed block of rows x columns and rows x factors; ``names`` by the codes."""
    own, short = [], []
    for i, listed in enumerate(names):
        met, local = np.unique(codes[:, i], return_inverse=True)
        own.append([listed[k] for k in met])
        short.append(local.astype(np.uint16 if len(met) <= 1 << 16 else np.uint32))
    data = pickle.dumps((np.ascontiguousarray(values.T), short, own), protocol=5)
    return len(data), pa.compress(data, codec="lz4", asbytes=True)


def packed_rows(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str | tuple[str, str]], factors: Sequence[str], wide: int | None, buckets: int,
    layout: tuple[tuple[int, ...], ...] | None = None,
) -> DataFrame:
    """keys, ``__bucket``, ``size``, ``block``; rows without weight (the second column) say nothing and are left out.

    ``layout``: the last columns are what the terms are products of.
    """
    keys, columns, factors = list(keys), list(columns), list(factors)
    bucket = F.lit(0) if wide is None else F.pmod(F.crc32(F.col(factors[wide]).cast("binary")), F.lit(buckets)).cast("int")
    rows = rows.filter(F.col(columns[1]) != 0).select(*keys, bucket.alias("__bucket"), *read(columns), *factors)
    if wide is not None:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        rows = rows.hint("rebalance", "__bucket" if buckets > 2 * cores else factors[wide])
    schema = StructType(
        [*(rows.schema[k] for k in keys), StructField("__bucket", IntegerType()), StructField("size", IntegerType()), StructField("block", BinaryType())]
    )
    arrow = to_arrow_schema(schema)
    numbers = 0 if layout is None else 1 + max(p for parts in layout for p in parts)
    many = max(1, min(BLOCK_ROWS, BLOCK_CELLS // (len(columns) - numbers + len(layout or ()) + len(factors))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict[str, int]] = [{} for _ in factors]
        names: list[list[str]] = [[] for _ in factors]
        gathered: dict[tuple, list] = {}  # rows, values, codes
        held = 0

        def out(head: tuple) -> Iterator[pa.RecordBatch]:
            _, values, codes = gathered.pop(head)
            values, codes = np.concatenate(values), np.concatenate(codes)
            for low in range(0, len(values), many):
                size, data = _packed(values[low : low + many], codes[low : low + many], names)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*head, size, data), arrow, strict=True)], schema=arrow)

        for batch in batches:
            if not len(batch):
                continue
            values = np.column_stack(numbers_of(batch, columns))
            if layout is not None and not np.isfinite(values.sum()):
                # Products of nothing and what has no bound: such rows are incomplete.
                formed = laid_out(list(values[:, -numbers:].T), layout, np.empty((len(layout), len(values))))
                kept = ~np.isnan(formed).any(axis=0)
                batch, values = batch.filter(pa.array(kept)), values[kept]
            codes = np.empty((len(batch), len(factors)), np.int32)
            for i, f in enumerate(factors):
                coded = batch.column(f).dictionary_encode()
                own = []
                for name in coded.dictionary.to_pylist():
                    if name not in known[i]:
                        known[i][name] = len(names[i])
                        names[i].append(name)
                    own.append(known[i][name])
                codes[:, i] = np.array(own, np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
            for head, at in _key_groups(batch, (*keys, "__bucket")):
                mine = gathered.setdefault(head, [0, [], []])
                mine[0] += len(at)
                mine[1].append(values[at])
                mine[2].append(codes[at])
                held += len(at)
                if mine[0] >= many:
                    held -= mine[0]
                    yield from out(head)
            while held > OPEN_BLOCKS * many:
                largest = max(gathered, key=lambda h: gathered[h][0])
                held -= gathered[largest][0]
                yield from out(largest)
        for head in list(gathered):
            yield from out(head)

    return rows.mapInArrow(run, schema)


def with_solution(
    blocks: DataFrame, solution: DataFrame | None, keys: Sequence[str], wide: int | None, buckets: int, small: bool = False
) -> DataFrame:
    """Blocks with ``__rest`` (coefficients and effects of the key) and ``__own`` (effects of the bucket's wide levels).

    ``small``: the solution may be sent to every executor, so the blocks stay where they are.
    """
    keys, sent = list(keys), F.broadcast if small else lambda table: table
    row = F.struct("kind", "term", "level", "estimate")
    none = F.lit(None).cast("array<struct<kind:string,term:string,level:string,estimate:double>>")
    if solution is None:
        return blocks.withColumns({"__rest": none, "__own": none})
    solution = solution.filter("kind IN ('coef', 'level')")
    far = (F.col("kind") == "level") & (F.col("term") == F.lit(str(wide)))
    rest = solution.filter(~far).groupBy(*keys).agg(F.collect_list(row).alias("__rest"))
    met = blocks.join(sent(rest), keys) if keys else blocks.withColumn("__rest", rest.scalar())
    if wide is None:
        return met.withColumn("__own", none)
    bucket = F.pmod(F.crc32(F.col("level").cast("binary")), F.lit(buckets)).cast("int")
    own = solution.filter(far).groupBy(*keys, bucket.alias("__bucket")).agg(F.collect_list(row).alias("__own"))
    return met.join(sent(own), [*keys, "__bucket"])


class Effects:
    """The parts of a solution that a block's rows need."""

    def __init__(self, terms: Sequence[str], m: int, rows: Sequence[dict]):
        self.beta = np.zeros(len(terms))
        self.levels: list[dict[str, float]] = [{} for _ in range(m)]
        place = {t: i for i, t in enumerate(terms)}
        for r in rows:
            if r["kind"] == "coef":
                self.beta[place[r["term"]]] = r["estimate"]
            else:
                self.levels[int(r["term"])][r["level"]] = r["estimate"]

    def predictor(self, x: np.ndarray, codes: list[np.ndarray], names: list[list[str]]) -> np.ndarray:
        eta = self.beta @ x if len(x) else np.zeros(len(codes[0]))
        for own, c, listed in zip(self.levels, codes, names, strict=True):
            eta += np.array([own[name] for name in listed])[c]
        return eta


def block_states(
    blocks: DataFrame, solution: DataFrame | None, plan: Plan, terms: Sequence[str], lead: int, working: Working,
    small: bool = False,
) -> DataFrame:
    """One state for each key and bucket, as ``accumulate.states``: of what ``working`` makes of the blocks.

    ``lead`` is the number of a block's columns before the terms.
    """
    keys, m, p, n = list(plan.keys), len(plan.factors), plan.p, len(plan.keys)
    numbers, alike = len(plan.columns) - 1, Alike(plan.layout)
    met = with_solution(blocks, solution, keys, plan.wide, plan.buckets, small).select(*keys, "__bucket", "size", "block", "__rest", "__own")
    schema = StructType(
        [*(blocks.schema[k] for k in keys), StructField("__group", IntegerType()), StructField("__bucket", IntegerType()), StructField("__state", BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, State] = {}
        at, effects = None, None
        for batch in batches:
            for row in range(len(batch)):
                head = tuple(batch.column(c)[row].as_py() for c in range(n + 1))
                size, data = batch.column(n + 1)[row].as_py(), batch.column(n + 2)[row].as_py()
                values, codes, names = pickle.loads(pa.decompress(data, decompressed_size=size, codec="lz4"))
                z, eta = np.empty((p, values.shape[1])), None
                x = laid_out(values[lead : lead + numbers], plan.layout, z[1:])
                if batch.column(n + 3)[row].is_valid:
                    if at != head:
                        at = head
                        effects = Effects(terms, m, [*batch.column(n + 3)[row].as_py(), *(batch.column(n + 4)[row].as_py() or [])])
                    eta = effects.predictor(x, codes, names)
                z[0], w, extra = working(values, eta)
                if not all(np.isfinite(a.sum()) or np.isfinite(a).all() for a in (z, w, extra)):
                    raise ValueError("the weighted sums are not finite")
                state = states.setdefault(head[:n], State(p, m, 1, len(plan.extra)))
                numbered = [state.codes(i, names[i])[codes[i]] for i in range(m)]
                state.add(z.T, w[:, None], numbered, extra.T, alike.groups(values[lead : lead + numbers]))
                if _outgrown(states):
                    yield from _handed(states, plan, arrow)
                    states = {}
        yield from _handed(states, plan, arrow)

    return merged_states(met.mapInArrow(run, schema), schema, plan)
