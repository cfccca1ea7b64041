"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. A bounded sample of labelled rows (``SAMPLE`` of each class, those with the
   least key hash) gives word lists: words, and starts of words as patterns, whose
   presence speaks for toxicity. Each is a voter; further voters count hits, or
   vote for a clean text when there are none. A voter may abstain.
2. The label model is a generative model of the votes given the unseen class. The
   vote of a voter depends on the class and on one other voter: a forest of the
   strongest conditional correlations, so that voters that repeat one another do
   not count twice. Expectation maximisation estimates class share, accuracies and
   correlations; the given label enters as one more noisy voter.
3. The posterior labels of the sample train a linear classifier over hashed words
   and word starts; it sees neither voters nor labels, and scores every text.

Texts are folded into distinct words before anything is hashed, so a repeated
word counts once. Nulls: a null text is an empty one and gets the score of a text
without words; a null key is never in the sample. Rows that repeat come back each;
of several labels of a key the larger one counts. With no labels of one class the
score is the constant share of the other. An empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.llm.common import slices, spread, words_of

# Rows of each class in the sample.
SAMPLE = 3_000
BUCKETS = 1 << 18
START = 6  # characters of a word start
LEXICON, PATTERNS = 150, 100  # the most voters of either kind
SUPPORT = 3  # toxic texts that have to hold a voter's word
PRECISION = 0.8
EDGE = 0.01  # least conditional mutual information of a pair that counts as correlated
GIVEN_RIGHT = 0.93  # how often a given label is taken to be right
EM_STEPS, FIT_STEPS, RIDGE, SMOOTH = 30, 150, 1.0, 5.0
MARKS = ".,;:!?\"'()[]{}<>|#*$%&-_/\\"


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of every distinct word of each text, then of its start; words come first in pairs."""
    offsets, codes, vocabulary = words_of(texts)
    bare = pc.utf8_trim(pc.utf8_lower(vocabulary), MARKS)
    coded = bare.dictionary_encode()
    words = coded.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    word = np.array([digest(w, 1) % BUCKETS for w in words], np.int64)
    start = np.array([digest(w[:START], 2) % BUCKETS if len(w) > START else -1 for w in words], np.int64)
    empty = np.array([not w for w in words], bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)[codes]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    once = ~pd.Series(owner * max(1, len(words)) + codes).duplicated().to_numpy() & ~empty[codes]
    owner, codes = owner[once], codes[once]
    long = start[codes] >= 0
    return np.concatenate((owner, owner[long])), np.concatenate((word[codes], start[codes][long]))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            owner, bucket = features_of(pc.fill_null(part.column("text"), ""))
            order = np.argsort(owner, kind="stable")
            ends = np.cumsum(np.bincount(owner, minlength=part.num_rows))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(bucket[order].astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays([part.column("y"), lists], ["y", "buckets"])


class Voters:
    """Votes of each sampled text: 1 for toxic, 2 for clean, 0 for neither."""

    def __init__(self, owner: np.ndarray, bucket: np.ndarray, y: np.ndarray):
        n, toxic = len(y), y > 0.5
        hits = np.bincount(bucket[toxic[owner]], minlength=BUCKETS)
        misses = np.bincount(bucket[~toxic[owner]], minlength=BUCKETS)
        # As if both classes were as frequent in the corpus as in the sample's shares.
        rate = (hits + 0.5) / (toxic.sum() + 1), (misses + 0.5) / ((~toxic).sum() + 1)
        good = (hits >= SUPPORT) & (rate[0] / (rate[0] + rate[1]) >= PRECISION)
        score = np.where(good, np.log(rate[0] / rate[1]) * np.sqrt(hits), 0.0)
        chosen = np.argsort(-score, kind="stable")[: LEXICON + PATTERNS]
        self.chosen = chosen[score[chosen] > 0]
        at = np.full(BUCKETS, -1)
        at[self.chosen] = np.arange(len(self.chosen))
        inside = at[bucket] >= 0
        present = np.zeros((n, len(self.chosen)), bool)
        present[owner[inside], at[bucket[inside]]] = True
        count = present.sum(axis=1)
        size = np.bincount(owner, minlength=n)
        pattern = [
            np.where(count >= 2, 1, 0),
            np.where(count >= 4, 1, 0),
            np.where((count * 40 > size) & (count > 0), 1, 0),
            np.where(count == 0, 2, 0),
            np.where((count == 0) & (size >= 60), 2, 0),
            np.where((count <= 1) & (size >= 200), 2, 0),
        ]
        self.votes = np.concatenate((present.astype(np.int8), np.stack(pattern, axis=1).astype(np.int8)), axis=1)


def _shares(votes: np.ndarray, parent: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P(vote | class, parent's vote), smoothed: axes class, parent's vote, vote, voter."""
    m = votes.shape[1]
    table = np.full((2, 3, 3, m), 0.1)
    above = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
    for up in range(3):
        for own in range(3):
            both = ((above == up) & (votes == own)).astype(float)
            table[1, up, own] += q @ both
            table[0, up, own] += (1 - q) @ both
    return table / table.sum(axis=2, keepdims=True)


def _forest(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: none) in the forest of the largest conditional mutual information."""
    n, m = votes.shape
    weight = np.stack((1 - q, q))
    value = np.zeros((m, m))
    ones = [(votes == v).astype(float) for v in range(3)]
    for w in weight:
        total = max(w.sum(), 1e-9)
        single = [(w @ o) / total for o in ones]
        for a in range(3):
            for b in range(3):
                joint = (ones[a] * w[:, None]).T @ ones[b] / total
                with np.errstate(divide="ignore", invalid="ignore"):
                    part = joint * np.log(joint / np.outer(single[a], single[b]))
                value += np.nan_to_num(part) * total / n
    np.fill_diagonal(value, 0)
    parent, inside, link = np.full(m, -1), np.zeros(m, bool), np.full(m, -1.0)
    for _ in range(m):  # Prim's algorithm; an edge too weak starts a new tree
        nxt = int(np.argmax(np.where(inside, -np.inf, link)))
        if link[nxt] < EDGE:
            parent[nxt] = -1
        inside[nxt] = True
        better = ~inside & (value[nxt] > link)
        link[better], parent[better] = value[nxt][better], nxt
    return parent


def label_model(votes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """P(toxic) of each row from all votes, the given labels being one noisy voter among them."""
    prior = float(np.clip(given.mean(), 0.01, 0.99))
    q = np.where(given > 0.5, GIVEN_RIGHT, 1 - GIVEN_RIGHT)
    told = np.where(given > 0.5, 1, -1) * np.log(GIVEN_RIGHT / (1 - GIVEN_RIGHT))
    parent = _forest(votes, q)
    above = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
    column = np.arange(votes.shape[1])
    for _ in range(EM_STEPS):
        table = _shares(votes, parent, q)
        ratio = np.log(table[1]) - np.log(table[0])
        odds = ratio[above, votes, column].sum(axis=1) + told + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - q).max() < 1e-4
        q, prior = new, float(np.clip(new.mean(), 0.01, 0.99))
        if done:
            break
    return q


def train(owner: np.ndarray, bucket: np.ndarray, q: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels, by accelerated gradient steps.

    Each feature is scaled by its smoothed log ratio between the classes, so that
    the penalty falls on what tells them apart no better than chance.
    """
    n = len(q)
    seen = np.bincount(bucket, minlength=BUCKETS)
    keep = seen[bucket] >= SUPPORT
    owner, bucket = owner[keep], bucket[keep]
    used, column = np.unique(bucket, return_inverse=True)
    classes = [np.bincount(column, c[owner], minlength=len(used)) for c in (q, 1 - q)]
    rates = [(c + SMOOTH * s / n) / (s + SMOOTH * s / n) for c, s in zip(classes, (q.sum(), (1 - q).sum()), strict=True)]
    x = np.log(rates[0] / rates[1])
    # A diagonal bound of the curvature: rows of many features take shorter steps.
    size = np.bincount(owner, np.abs(x)[column], minlength=n) + 1
    scale = np.bincount(column, (weight * size / 4)[owner], minlength=len(used)) * np.abs(x) + RIDGE
    scale_b = float((weight * size).sum() / 4)
    w, b = np.zeros(len(used)), float(np.log((weight @ q + 1) / (weight @ (1 - q) + 1)))
    w_ahead, b_ahead, pace = w, b, 1.0
    for _ in range(FIT_STEPS):
        z = np.bincount(owner, (x * w_ahead)[column], minlength=n) + b_ahead
        miss = weight * (q - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        w_new = w_ahead + (x * np.bincount(column, miss[owner], minlength=len(used)) - RIDGE * w_ahead) / scale
        b_new = b_ahead + miss.sum() / scale_b
        pace_new = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        w_ahead = w_new + (pace - 1) / pace_new * (w_new - w)
        b_ahead = b_new + (pace - 1) / pace_new * (b_new - b)
        w, b, pace = w_new, b_new, pace_new
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = x * w
    return weights, b


def _scored(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, bucket = features_of(pc.fill_null(part.column("text"), ""))
                z = np.bincount(owner, weights[bucket], minlength=part.num_rows) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(score)], ["key", "score"])

    return run


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(rows: DataFrame, labels: DataFrame, key: str) -> tuple[np.ndarray, float]:
    """Weights and bias from the sample; labels of held-out keys are never read into it."""
    told = labels.select(F.col(key).cast("long").alias("key"), F.col("toxic").alias("y"))
    told = told.where(F.col("key").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("key")))
    per_key = told.groupBy("key").agg(F.max("y").alias("y"))
    by_hash = [F.xxhash64("key"), F.col("key")]
    chosen = [per_key.where(F.col("y") == y).orderBy(*by_hash).limit(SAMPLE) for y in (0, 1)]
    share = per_key.agg(F.avg("y")).first()[0]
    sample = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "key").orderBy(*by_hash).limit(2 * SAMPLE)
    found = sample.select("y", "text").mapInArrow(_sampled, "y int, buckets array<int>").toArrow()
    y = found.column("y").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    sizes = pc.list_value_length(found.column("buckets")).to_numpy()
    owner, bucket = np.repeat(np.arange(len(y)), sizes), pc.list_flatten(found.column("buckets")).to_numpy()
    q = label_model(Voters(owner, bucket, y).votes, y)
    # The sample holds more toxic rows than the corpus; weights restore the share.
    weight = np.where(y > 0.5, share / y.mean(), (1 - share) / (1 - y.mean()))
    return train(owner, bucket, q, weight)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, held_out, score, predicted``."""
    rows = spread(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    weights, bias = fitted(rows, labels, key)
    scored = rows.mapInArrow(_scored(weights, bias), "key long, score double")
    return scored.select(
        F.col("key").alias(key),
        held_out(F.col("key")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
