"""Closest texts found in a task, against plain Python."""

import random

import pyarrow as pa
import pytest

from moodgrid.operators import joins, nearest


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("letters, longest", [("01", 9), ("0123456789", 12), ("aé日😀b", 20), ("abcdefgh", 40), ("ab", 64)])
def test_closest_is_the_first_of_the_nearest(monkeypatch, letters, longest):
    monkeypatch.setattr(nearest, "PAIRS", 256)  # so that bands are used
    rng = random.Random(longest)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
    held = sorted({word() for _ in range(60)}, key=lambda t: t.encode())
    change = lambda t: t[: rng.randint(0, len(t))] + rng.choice(letters) + t[rng.randint(0, len(t)) :]
    asked = [word() for _ in range(30)] + [change(rng.choice(held))[:longest] for _ in range(40)] + [""]
    which, edits = nearest.closest(pa.array(asked), pa.array(held))
    for text, at, d in zip(asked, which.tolist(), edits.tolist(), strict=True):
        assert (d, at) == min((edit(text, t), i) for i, t in enumerate(held))


def test_groups_within_a_task_explode_nothing(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("0123456") for _ in range(rng.randint(4, 11)))
    a = [(rng.choice([0, 1, 2, None]), word()) for _ in range(80)]
    b = [(rng.choice([0, 1, None]), rng.choice([word(), word(), None]), i) for i in range(90)] + [(1, "x" * 70, 0)]
    left, right = spark.createDataFrame(a, "at int, id string"), spark.createDataFrame(b, "at int, id string, v int")
    one = {(r.at, r.id): (r.edit_distance, r.m) for r in joins.nearest_key_join(left, right, ["at"], "id", "m").collect()}
    for at, s in a:
        best = min(((edit(s, t), t) for bt, t, _ in b if bt == at and at is not None and t is not None), default=(None, None))
        assert one[(at, s)] == best
    monkeypatch.setattr(joins, "OPEN_TEXTS", 5)  # several copies of a group
    monkeypatch.setattr(joins, "_by_pieces", lambda *a: pytest.fail("exploded"))
    short = right.filter("length(id) < 20")
    two = {(r.at, r.id): (r.edit_distance, r.m) for r in joins.nearest_key_join(left, short, ["at"], "id", "m").collect()}
    assert {k: v for k, v in two.items() if v[0] != one[k][0]} == {}
