from collections import Counter

import numpy as np

from moodgrid.llm import decontamination

ITEMS = "item_id long, text string"


def words(n, seed):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)]


def brute(docs, items):
    """Every document and item along every offset, judged like the operator judges."""
    found = {}
    bare = lambda t: [w for w in (x.lower().strip(decontamination.MARKS) for x in t.split()) if w]
    for key, text in docs:
        doc = bare(text or "")
        for item, body in items:
            q = bare(body or "")
            best = []
            for shift in range(-len(q), len(doc)):
                first = max(0, -shift)
                size = min(len(q), len(doc) - shift) - first
                if size <= 0:
                    continue
                same = np.array([doc[first + shift + i] == q[first + i] for i in range(size)])
                start, end, n = decontamination.stretch(same)
                if n >= min(decontamination.LEAST, len(q)) and n:
                    best.append((-n, first + shift + start, end - start))
            if best:
                n, place, length = min(best)
                found[key, item] = (place, length, -n)
    return found


def test_planted_passages(spark):
    item = words(40, 1)
    one_off = item.copy()
    one_off[20] = "changed"
    many_off = [w if i % 2 else "changed" for i, w in enumerate(item)]
    around = words(200, 2)
    docs = [
        (1, " ".join(around + item + around)),
        (2, " ".join(around + one_off)),
        (3, " ".join(w.upper() + "," for w in item)),
        (4, " ".join(around + many_off)),
        (5, " ".join(around)),
        (6, " ".join(item[:11])),
        (7, " ".join(around[:9] + item[:14])),
        (8, "so x foo bar baz y"),
        (9, ""),
    ]
    items = [(0, " ".join(item)), (1, "foo bar baz"), (2, ""), (3, " ".join(words(30, 3)))]
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    got = {(r["doc_id"], r["item_id"] if "item_id" in r else r["item"]): (r["place"], r["words"], r["matches"]) for r in got.collect()}
    want = brute(docs, items)
    assert got == want
    assert {k for k, _ in got} == {1, 2, 3, 7, 8}


def test_agrees_with_brute_force_on_given_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    some = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    q = [tuple(r) for r in items.select("item_id", "text").collect()]
    close = {(k, i) for (k, i), (_, n, m) in brute(some[:40], q[:20]).items() if n - m <= 1}
    got = {(r[0], r[1]) for r in decontamination.overlaps(docs, items).collect()}
    assert close <= got


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(0, "alpha beta gamma delta epsilon"), (1, None), (None, "one two three four five six"), (2, " ")], ITEMS)
    got = decontamination.overlaps(odd, items).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, 5, 5)]
    kept = decontamination.clean(odd, items)
    assert kept.columns == odd.columns
    want = Counter(map(repr, (r for r in odd.collect() if r["text"] != "alpha beta gamma delta epsilon")))
    assert Counter(map(repr, kept.collect())) == want
    assert decontamination.clean(odd, items.limit(0)).count() == odd.count()
    assert decontamination.clean(odd.limit(0), items).count() == 0
