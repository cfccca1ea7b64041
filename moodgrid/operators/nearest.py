"""Closest texts of one group by edits, in a task's memory.

Distances come bit-parallel (Myers 1999, Hyyrö 2003): a column of the edit matrix is one
machine word, and a step advances all pairs at once. Only pairs that may be near are looked
at: under k edits one of k + 1 segments of a text stays whole and moves by at most k places,
so hashes of such places are met first, for k = 1, 2, 3, 4; hashes may collide, distances
are exact. Where that would leave most pairs, and for texts still open, all pairs are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters of the longest text, pairs that are worked on at once, texts without a candidate near.
LONGEST = 64
PAIRS = 1 << 17
BANDS = (1, 2, 3, 4)
OPEN_ROWS = 4_096
BASE = np.uint64(0x9E3779B97F4A7C15)
FAR = np.iinfo(np.int64).max


class Letters:
    """Texts as rows of letters, numbered by ``known`` (0 behind a text's end), with hashes of their beginnings."""

    def __init__(self, points: np.ndarray, lengths: np.ndarray, known: np.ndarray):
        self.size = lengths
        width = int(lengths.max(initial=0))
        self.letters = np.zeros((len(lengths), width), np.int64)
        self.letters[np.arange(width) < lengths[:, None]] = np.searchsorted(known, points) + 1
        self.begun = np.zeros((len(lengths), width + 1), np.uint64)
        for t in range(width):
            self.begun[:, t + 1] = self.begun[:, t] * BASE + self.letters[:, t].astype(np.uint64)

    def part(self, rows: np.ndarray, start: int, size: int) -> np.ndarray:
        """Hashes of ``size`` letters from ``start``."""
        power = np.uint64(pow(int(BASE), size, 1 << 64))
        return self.begun[rows, start + size] - self.begun[rows, start] * power


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), pc.utf8_length(texts).to_numpy().astype(np.int64)


def _distances(equal: Callable[[int], np.ndarray], m: np.ndarray, n: np.ndarray, steps: int) -> np.ndarray:
    """Edits between texts of m and of n letters; ``equal(t)`` has a bit for each place of the first that holds letter t of the second."""
    kind = np.uint16 if m.max(initial=0) <= 16 else np.uint32 if m.max(initial=0) <= 32 else np.uint64
    one = kind(1)
    last = np.where(m > 0, one << np.maximum(m - 1, 0).astype(kind), kind(0)).astype(kind)
    shape = np.broadcast_shapes(m.shape, n.shape)
    plus, minus = np.full(shape, ~kind(0), kind), np.zeros(shape, kind)
    score = np.broadcast_to(m, shape).astype(np.int16)
    for t in range(steps):
        there = equal(t).astype(kind, copy=False)
        here = n > t
        vertical = there | minus
        horizontal = (((there & plus) + plus) ^ plus) | there
        up, down = minus | ~(horizontal | plus), plus & horizontal
        score += ((up & last) != 0) & here
        score -= ((down & last) != 0) & here
        up, down = (up << one) | one, down << one
        plus, minus = down | ~(vertical | up), up & vertical
    return np.where(m > 0, score, n).astype(np.int64)


def _places(open_: Letters, rows: np.ndarray, held: Letters, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, where their matches begin, how many there are, and the held texts in that order."""
    by_size = {int(n): rows[open_.size[rows] == n] for n in np.unique(open_.size[rows])}
    for long in np.unique(held.size).tolist():
        near = {n: mine for n, mine in by_size.items() if abs(n - long) <= k}
        if not near:
            continue
        of = np.flatnonzero(held.size == long)
        step, more = divmod(long, k + 1)
        start = 0
        for i in range(k + 1):
            size = step + (i >= k + 1 - more)
            hashes = held.part(of, start, size)
            order = np.argsort(hashes, kind="stable")
            listed, texts = hashes[order], of[order]
            for n, mine in near.items():
                for at in range(max(start - k, 0), min(start + k, n - size) + 1):
                    asked = open_.part(mine, at, size)
                    first = np.searchsorted(listed, asked, "left")
                    yield mine, first, np.searchsorted(listed, asked, "right") - first, texts
            start += size


def closest(open_texts: pa.Array, held_texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each open text the first of the nearest held ones, and the edits; texts have at most ``LONGEST`` letters."""
    (one, m), (two, n) = _points(open_texts), _points(held_texts)
    known = np.unique(np.concatenate((one, two)))
    ours, held = Letters(one, m, known), Letters(two, n, known)
    many, width = len(n), held.letters.shape[1]
    kind = np.uint16 if ours.letters.shape[1] <= 16 else np.uint32 if ours.letters.shape[1] <= 32 else np.uint64
    best = np.full(len(m), FAR)

    def bits(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(known) + 1), kind)
        for t in range(ours.letters.shape[1]):
            out[np.arange(len(rows)), ours.letters[rows, t]] |= kind(1) << kind(t)
        out[:, 0] = 0
        return out

    def settle(rows: np.ndarray, matches: list, k: int) -> None:
        places = bits(rows)
        number = np.zeros(len(m), np.int64)
        number[rows] = np.arange(len(rows))
        for mine, first, count, texts in matches:
            ends = np.cumsum(count)
            low = 0
            while low < len(mine):
                done = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                some = count[low:high]
                if some.sum():
                    who = np.repeat(mine[low:high], some)
                    at = np.repeat(first[low:high] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
                    which = texts[at]
                    rank = number[who]
                    edits = _distances(lambda t: places[rank, held.letters[which, t]], m[who], n[which], width)  # noqa: B023
                    near = edits <= k
                    np.minimum.at(best, who[near], edits[near] * many + which[near])
                low = high

    left = np.arange(len(m))
    for k in BANDS:
        if len(left) * many <= PAIRS:
            break
        matches, total = [], 0
        for found in _places(ours, left, held, k):
            total += int(found[2].sum())
            if total * 2 > len(left) * many:
                break
            matches.append(found)
        if total * 2 > len(left) * many:
            break
        step = max(1, (8 << 20) // (len(known) + 1))
        if step >= len(left):
            settle(left, matches, k)
        else:
            for low in range(0, len(left), step):
                settle(left[low : low + step], list(_places(ours, left[low : low + step], held, k)), k)
        left = left[best[left] == FAR]
    step = max(1, min(PAIRS // max(many, 1), (8 << 20) // (len(known) + 1)))
    for low in range(0, len(left), step):
        rows = left[low : low + step]
        places = bits(rows)
        edits = _distances(lambda t: places[:, held.letters[:, t]], m[rows][:, None], n[None, :], width)  # noqa: B023
        best[rows] = (edits * many + np.arange(many)).min(axis=1)
    return best % many, best // many


def grouped(schema: pa.Schema):
    """Rows by group and salt, held texts (``side`` 0) before open ones, each in their order: group, text, ``__r``, ``__d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, open_, waiting = None, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal open_, waiting
            if held and open_:
                asked, listed = pa.concat_arrays(open_), pa.concat_arrays(held)
                which, edits = closest(asked, listed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(asked), at[0], np.int64)), asked, listed.take(pa.array(which)), pa.array(edits.astype(np.int32))],
                    schema=schema,
                )
            open_, waiting = [], 0

        for batch in batches:
            numbers = [batch.column(c).to_numpy().astype(np.int64) for c in ("__g", "__salt", "__side")]
            text = batch.column("__l").cast(pa.string())
            starts = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in numbers], axis=0)))) if len(batch) else []
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                group = int(numbers[0][a]), int(numbers[1][a])
                if group != at:
                    yield from out()
                    at, held = group, []
                if numbers[2][a] == 0:
                    held.append(text.slice(a, b - a))
                    continue
                open_.append(text.slice(a, b - a))
                waiting += b - a
                if waiting >= OPEN_ROWS:
                    yield from out()
        yield from out()

    return run
