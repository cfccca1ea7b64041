r"""Quality rules learned as gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, in vectors over slices of
texts, into a narrow written table. Trees are fitted on a bounded sample of the
labelled documents (``SAMPLE`` rows, those with the least key hash), with
second-order boosting on binned features; some features may only lower the score
as they grow (``FALLING``). The fitted trees are flattened into arrays of nodes,
which every task walks for all its rows at once.

Nulls: a null text has no words. A text without words has zero statistics; it
fails the base rule. Rows that repeat come back each; a key with several labels
counts with the larger one; a null label or key is left out of the sample. With
no labels, or one class only, the base rule alone decides. An empty table gives
an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgrid.llm.common import row_hash, slices, spread, staged, words_of

# The most labelled rows the trees are fitted on.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 64
LEAST_ROWS, SHRINK = 10, 1.0
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Each a share or a mean, so that a text's length alone decides nothing.
FEATURES = (
    "log_words",
    "word_length",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "upper_share",
    "digit_share",
    "mark_share",
    "bar_share",
    "stop_share",
    "line_words",
)
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "bar_share")
STATS = "key long, row_hash long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{f} double" for f in FEATURES)


def repeated_words(offsets: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """Words of each text inside windows of three that its text holds twice or more."""
    n, texts = len(codes), len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    if n < 3:
        return np.zeros(texts, np.int64)
    codes = codes.astype(np.int64)
    pairs = codes[:-2] * size + codes[1:-1]
    if size >= 1 << 21:  # three codes would not fit into one integer
        pairs = pd.factorize(pairs)[0]
    window = pd.factorize(pairs * size + codes[2:])[0].astype(np.int64)
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    at = owner[inside] * n + window[inside]
    twice = inside[pd.Series(at).duplicated(keep=False).to_numpy()]
    marked = np.zeros(n, bool)
    for step in range(3):
        marked[twice + step] = True
    return np.bincount(owner[marked], minlength=texts)


def _repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = pc.fill_null(part.column("text"), "")
            offsets, codes, vocabulary = words_of(texts)
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)

            def total(of_word: pa.Array, owner=owner, codes=codes, n=n) -> np.ndarray:
                values = of_word.to_numpy(zero_copy_only=False)[codes]
                return np.bincount(owner, values, minlength=len(n)).astype(np.int64)

            def count(pattern: str, vocabulary=vocabulary, total=total) -> np.ndarray:
                return total(pc.count_substring_regex(vocabulary, pattern))

            chars = total(pc.utf8_length(vocabulary))
            symbols = count(r"[#*$%&|<>]")
            lines, dup = np.array([_repeated_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2).T
            repeats = repeated_words(offsets, codes, max(1, len(vocabulary)))
            distinct = np.bincount(owner[~pd.Series(owner * max(1, len(vocabulary)) + codes).duplicated().to_numpy()], minlength=len(n))
            words, letters = np.maximum(n, 1), np.maximum(chars, 1)
            values = (
                np.log1p(n),
                chars / words,
                symbols / words,
                dup / np.maximum(lines, 1),
                repeats / words,
                distinct / words,
                count(r"\p{Lu}") / letters,
                count(r"\p{Nd}") / letters,
                count(r"!") / words,
                count(r"\|") / words,
                count(r"[.,;:?]") / words,
                np.log1p(n / np.maximum(lines, 1)),
            )
            counts = (n, chars, symbols, dup, repeats)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("row_hash"), *(pa.array(np.asarray(c, np.int64)) for c in counts), *map(pa.array, values)],
                ["key", "row_hash", *COUNTS, *FEATURES],
            )


@dataclass(frozen=True)
class Trees:
    """All trees in one set of node arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                low = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            raw += self.value[at]
        return 1.0 / (1.0 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, falling: np.ndarray) -> Trees:
    """Boosted trees for P(y = 1); ``falling`` marks features that may only lower it.

    A split on such a feature needs a left value (smaller feature) that is no less
    than the right one, and both sides stay beyond the middle in all later splits.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    nodes: list[list] = []
    roots = []

    def add(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        top = None
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            at = binned[rows, j]
            sums = [np.cumsum(np.bincount(at, w, minlength=len(cut) + 1))[:-1] for w in (g[rows], h[rows], None)]
            gl, hl, nl = sums
            gr, hr, nr = g[rows].sum() - gl, h[rows].sum() - hl, len(rows) - nl
            vl, vr = np.clip(gl / (hl + SHRINK), low, high), np.clip(gr / (hr + SHRINK), low, high)
            gain = vl * gl - vl**2 * (hl + SHRINK) / 2 + vr * gr - vr**2 * (hr + SHRINK) / 2
            fits = (nl >= LEAST_ROWS) & (nr >= LEAST_ROWS) & (~falling[j] | (vl >= vr))
            if fits.any():
                k = int(np.argmax(np.where(fits, gain, -np.inf)))
                if top is None or gain[k] > top[0] + 1e-12:
                    top = (gain[k], j, k, vl[k], vr[k])
        return top

    def grow(node: int, rows: np.ndarray, g, h, depth: int, low: float, high: float) -> None:
        value = np.clip(g[rows].sum() / (h[rows].sum() + SHRINK), low, high)
        found = best(rows, g, h, low, high) if depth < DEPTH else None
        alone = value * g[rows].sum() - value**2 * (h[rows].sum() + SHRINK) / 2
        if found is None or found[0] <= alone + 1e-9:
            nodes[node][4] = RATE * value
            raw[rows] += RATE * value
            return
        _, j, k, vl, vr = found
        middle = (vl + vr) / 2
        bounds = ((middle, high), (low, middle)) if falling[j] else ((low, high), (low, high))
        goes = binned[rows, j] <= k
        children = add(0.0), add(0.0)
        nodes[node] = [j, cuts[j][k], *children, 0.0]
        for child, some, (a, b) in zip(children, (rows[goes], rows[~goes]), bounds, strict=True):
            grow(child, some, g, h, depth + 1, a, b)

    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-raw))
        roots.append(add(0.0))
        grow(roots[-1], np.arange(len(y)), y - p, p * (1 - p), 0, -np.inf, np.inf)
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    return Trees(*columns, np.array(roots), base)


def _sampled(stats: DataFrame, labels: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample: at most ``SAMPLE`` rows reach the driver."""
    judged = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key"))
    chosen = judged.agg(F.max("quality").alias("y")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    joined = stats.join(F.broadcast(chosen), "key").groupBy("key", "y").agg(*(F.min(f).alias(f) for f in FEATURES))
    rows = joined.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()
    return rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float)


def _judged(model: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            score = model.score(x) if model else np.ones(len(x))
            names = ("key", "row_hash", *COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    return run


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; equal rows share their fate."""
    bad = judge(docs, labels, key, text).where(~F.col("kept")).select(F.col("row_hash").alias("__judged_row")).distinct()
    rows = docs.withColumn("__judged_row", row_hash(key, text))
    return rows.join(bad, "__judged_row", "left_anti").drop("__judged_row")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``score`` (quality likelier near 1) and ``kept``.

    ``row_hash`` stands for key and text together.
    """
    rows = spread(docs.select(F.col(key).cast("long").alias("key"), row_hash(key, text).alias("row_hash"), F.col(text).alias("text")))
    stats = staged(rows.mapInArrow(_stats, STATS), "quality")
    x, y = _sampled(stats, labels, key)
    model = fit(x, y, np.isin(FEATURES, FALLING)) if len(np.unique(y)) > 1 else None
    schema = "key long, row_hash long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    scored = stats.mapInArrow(_judged(model), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= THRESHOLD)
    ).withColumnRenamed("key", key)
