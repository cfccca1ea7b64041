"""Periodic runs against trying every period at every place."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow.parquet as pq

from moodgrid.llm import queries, runs


def every_run(words):
    """Start, period and length of all runs, by definition."""
    n, first = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                first.setdefault((start, length), q)
    return sorted((s, q, length) for (s, length), q in first.items())


def without_repeats(words, found):
    gone = {i for s, q, length in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def documents(seed, many):
    rnd = random.Random(seed)
    for _ in range(many):
        n, letters = rnd.choice([0, 1, 5, 6, 7, 20, 61, 150, 400]), rnd.choice([1, 2, 3, 50])
        words = [f"w{rnd.randrange(letters)}" for _ in range(n)]
        if n and rnd.random() < 0.7:
            a = rnd.randrange(n)
            p = 1 + (n - a) // (3 + rnd.randrange(8))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            if rnd.random() < 0.4:
                words[rnd.randrange(n)] = "odd"
        yield words


def test_runs_and_collapsed_texts(spark):
    docs = list(documents(5, 400))
    table = spark.createDataFrame([(i, "  ".join(w) + "\n") for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(table).collect()}
    some = 0
    for i, words in enumerate(docs):
        want = every_run(words)
        some += len(want)
        assert [(r.start, r.period, r.length) for r in got[i].runs] == want
        assert got[i].n_words == len(words) and got[i].collapsed == without_repeats(words, want)
    assert some > 100


def test_z_function():
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.randrange(2) for _ in range(rnd.randrange(1, 30))]
        z = runs.z_function(s)
        for i in range(len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def test_one_period_below_another():
    """A long stretch of one word must not hide runs, nor be found with a multiple of its period."""
    words = ["x"] * 700 + ["y"] + (["a", "b", "a", "c"] * 40) + ["z"] * 5
    offsets = np.array([0, len(words)], np.int64)
    codes = np.unique(words, return_inverse=True)[1].astype(np.int64)
    found = runs.fragments(offsets, codes)[0]
    assert {q for q, _, _ in found} == {1, 4}


def test_odd_rows(spark, odd):
    rows = runs.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    by_words = {(r.doc_id, r.n_words) for r in rows}
    assert (2, 0) in by_words and (3, 0) in by_words and (None, 0) in by_words and (5, 40_000) in by_words
    long = next(r for r in rows if r.doc_id == 5)
    assert [(r.start, r.period, r.length) for r in long.runs] == [(0, 5, 40_000)]
    assert long.collapsed == "lorem ipsum dolor sit amet"
    assert runs.periodic_runs(odd.limit(0)).count() == 0


def test_query_agrees_with_sql(spark, small):
    got = queries.op11_runs(spark, small).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(queries.RUNS_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got[want.columns].astype(object).where(got[want.columns].notna(), None).equals(
        want.astype(object).where(want.notna(), None)
    )
    assert (got.n_runs > 0).sum() > 5


def test_digest_is_that_of_the_text(spark, small):
    docs = spark.createDataFrame(pq.read_table(f"{small}/documents.parquet").slice(0, 40).to_pandas())
    texts = {r.doc_id: r.collapsed for r in runs.periodic_runs(docs).collect()}
    for r in runs.periodic_runs(docs, digest=True).collect():
        assert r.collapsed == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
