"""The order in which packing retrieves, against BM25 over all terms in plain Python."""

from collections import Counter

import numpy as np
import pytest

from moodgrid.llm import packing


def bm25(docs, idf, mean, seed):
    counts = [Counter(d.tolist()) for d in docs]
    score = lambda d: sum(
        idf[t] * counts[d][t] * 2.2 / (counts[d][t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in counts[seed] if counts[d][t]
    )
    return sorted(range(len(docs)), key=lambda d: (-round(score(d), 6), d))


@pytest.mark.parametrize("matrix", [2_048, 0])
def test_common_terms_rank_too(monkeypatch, matrix):
    """In a shard of near copies nearly all terms are common; the order must still follow them."""
    monkeypatch.setattr(packing, "MATRIX", matrix, raising=False)
    rng = np.random.default_rng(5)
    body = rng.integers(3, 60, 80)
    docs = []
    for k in range(50):
        own = body.copy()
        own[rng.permutation(80)[: k % 30]] = rng.integers(3, 60, k % 30)
        docs.append(np.append(own, 2).astype(np.uint16))
    docs[17] = docs[4].copy()
    idf = rng.uniform(0.1, 6, 60)
    shard = packing.Shard(docs, idf, 81.0)
    for seed in (0, 4, 29, 49):
        assert shard.ranked(seed).tolist() == bm25(docs, idf, 81.0, seed)
