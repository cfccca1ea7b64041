"""Ranked search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from moodgrid.llm import queries, ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    """All scores by the formula, one document and query at a time."""
    split = [(key, terms(text)) for key, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    counts = [(key, Counter(t), len(t)) for key, t in split]
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for key, tf, n in counts:
            if not n:
                continue
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m))
                for w, times in asked.items() if tf[w]
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, many):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rnd.choices(words, weight, k=rnd.choice([0, 1, 5, 40, 300])))) for i in range(many)]
    docs += [(many + i, docs[i][1]) for i in range(60)]  # copies: ties
    items = [(i, " ".join(rnd.choices(words, weight, k=rnd.choice([0, 1, 3, 30])))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1_000, 8 << 20])
def test_against_scoring_everything(spark, shard_bytes):
    docs, items = corpus(4, 700)  # in shards of a few documents, or whole batches
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.search(ranked.build_index(left, shard_bytes=shard_bytes), right, 20).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(docs, items, 20)


def test_one_shard_rejects_blocks_and_stays_exact():
    """The pruned search of a shard equals all scores, and leaves blocks packed."""
    rnd = np.random.default_rng(2)
    lengths = rnd.integers(50, 400, 3_000)
    n_docs, n_terms = 3_000, int(lengths.sum())
    rows, full = [], np.zeros(3_000, np.int64)
    query = []
    for t, share in enumerate((0.9, 0.6, 0.4, 0.01, 0.002)):
        place = np.flatnonzero(rnd.random(3_000) < share)
        tf = rnd.integers(1, 6, len(place))
        best = ranked.impact(tf, lengths[place], n_docs, n_terms)
        groups, heads, count, ws, wt, at, data = ranked.packed(np.zeros(len(place), np.int64), place, tf)
        most = np.maximum.reduceat(best, heads)
        rows.append((f"t{t}", place[heads], place[heads + count - 1], most, at, count * 100 + ws * 10 + wt, data.tobytes()))
        weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * len(place) + 1)))
        query.append((f"t{t}", weight, weight * int(most.max())))
        full[place] += weight * best
    lists = ranked.Lists(rows)
    opened = []
    plain = lists.block
    lists.block = lambda term, b: opened.append((term, b)) or plain(term, b)
    places, scores = ranked.best_of_shard(lists, lengths, query, 20, n_docs, n_terms)
    floor = np.sort(full)[-20]
    want = np.flatnonzero((full >= floor) & (full > 0))
    assert places.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    # Some blocks of the common terms stay packed.
    assert len(set(opened)) < sum(len(r[1]) for r in rows)


def test_packed_blocks():
    rnd = np.random.default_rng(1)
    groups = np.sort(rnd.integers(0, 30, 5_000))
    place = np.concatenate([np.sort(rnd.choice(10**6, (groups == g).sum(), replace=False)) for g in range(30)])
    tf = rnd.choice([1, 2, 300, 70_000], 5_000)
    owner, heads, count, ws, wt, at, data = ranked.packed(groups, place, tf)
    found = [ranked.unpacked(data.tobytes(), place[h], c, a, b, x) for h, c, a, b, x in zip(heads, count, ws, wt, at, strict=True)]
    assert np.concatenate([f[0] for f in found]).tolist() == place.tolist()
    assert np.concatenate([f[1] for f in found]).tolist() == tf.tolist()
    assert count.max() == ranked.BLOCK and owner.tolist() == groups[heads].tolist()


def test_odd_rows(spark, odd):
    items = spark.createDataFrame(
        [(1, "one TWO alpha", "x"), (1, "one TWO alpha", "x"), (None, "lorem", None), (2, None, "x"), (3, "...", "x"), (4, "nowhere", "x")],
        "item_id long, text string, doc_id string",
    )
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    queried = [(r.item_id, r.text) for r in items.collect()]
    got = ranked.search(ranked.build_index(odd), items, 3).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(docs, queried, 3)
    index = ranked.build_index(odd.limit(0))
    assert ranked.search(index, items, 3).count() == 0
    assert ranked.search(ranked.build_index(odd), items.limit(0), 3).count() == 0


def test_query_agrees_with_sql(spark, small):
    got = queries.op13_ranked_search(spark, small).toPandas().sort_values(["item_id", "rank"]).reset_index(drop=True)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    want = con.execute(queries.RANKED_SQL).df().sort_values(["item_id", "rank"]).reset_index(drop=True)
    assert got[list(want.columns)].astype("int64").equals(want.astype("int64"))
