import re
from collections import Counter

import numpy as np
import xxhash

from moodgrid.llm import graph, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def mark_of(text, size=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(marks, distance=4):
    """Least index reachable from each fingerprint, by comparing all."""
    marks = np.array(marks, np.uint64)
    root = np.arange(len(marks))
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= distance
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            return root
        root = new


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    marks = list(base)
    for m in base[:150]:
        for flips in (1, 3, 4, 5):
            marks.append(m ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, flips, replace=False))))
    marks += [np.uint64(0), np.uint64((1 << 64) - 1), np.uint64(15)]
    marks = sorted(set(map(int, marks)))
    frame = spark.createDataFrame([(int(np.uint64(m).view(np.int64)),) for m in marks], "mark long")
    found = graph.components(simhash.links(frame, 4)).collect()
    unsigned = lambda x: int(np.int64(x).view(np.uint64))
    got = {m: m for m in marks} | {unsigned(r["node"]): unsigned(r["root"]) for r in found}
    want = roots_of(marks)
    groups = lambda of: Counter(frozenset(m for m in marks if of(m) == r) for r in {of(m) for m in marks})
    at = {m: i for i, m in enumerate(marks)}
    assert groups(got.get) == groups(lambda m: want[at[m]])


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7)]
    found = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert roots == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 80)}


def check(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    marks = [mark_of(t) for _, t in rows]
    root = roots_of(marks)
    least = {}
    for (key, _), r in zip(rows, root, strict=True):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    want = Counter((k, m, least.get(r)) for (k, _), m, r in zip(rows, marks, root, strict=True))
    got = Counter((r["doc_id"], int(np.int64(r["mark"]).view(np.uint64)), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root))
    keys = Counter(r["doc_id"] for r in kept.collect())
    assert keys == Counter(least.get(r) for r in set(root))


def test_components_agree_with_all_pairs(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_rows_and_empty_table(odd):
    check(odd)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.representatives(odd.limit(0)).count() == 0


def test_one_key_over_many_batches(spark, monkeypatch):
    """A key that many fingerprints share is compared in blocks, none left out."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    marks = [(i << 40) for i in range(200)]
    frame = spark.createDataFrame([(m,) for m in marks], "mark long")
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(frame, 4)).collect()}
    assert {found.get(m, m) for m in marks} == {0}
