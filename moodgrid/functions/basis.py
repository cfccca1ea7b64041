"""Regression basis columns: segments, cyclic tents and interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inner knots of the temperature response and of the day circle.
WBGT_KNOTS = (-10, 0, 5, 10, 15, 20, 25)
DAY_KNOTS = tuple(range(0, 25, 2))


class Terms(dict[str, Column]):
    """Columns by name; of products ``made`` tells the names of the columns they are made of, of 0/1 columns ``flags`` factor and level."""

    def __init__(
        self, *parts: dict[str, Column], made: dict[str, tuple[str, ...]] | None = None, flags: dict[str, tuple[str, str]] | None = None
    ):
        super().__init__()
        self.made: dict[str, tuple[str, ...]] = {}
        self.flags: dict[str, tuple[str, str]] = {}
        for part in parts:
            self.update(part)
            self.made = {n: m for n, m in self.made.items() if n not in part} | getattr(part, "made", {})
            self.flags = {n: f for n, f in self.flags.items() if n not in part} | getattr(part, "flags", {})
        self.made |= made or {}
        self.flags |= flags or {}

    def layout(self) -> tuple[dict[str, Column], list[tuple[int, ...]]]:
        """The columns that are no products of others here, and of each term the places of those it is made of."""
        whole = {n: m for n, m in self.made.items() if all(p in self and p not in self.made for p in m)}
        base = {n: c for n, c in self.items() if n not in whole}
        place = {n: i for i, n in enumerate(base)}
        return base, [tuple(place[p] for p in whole.get(n, (n,))) for n in self]


def _knot_name(x: str, knot: float) -> str:
    return f"{x}_{'m' if knot < 0 else ''}{abs(knot):g}".replace(".", "p")


def piecewise(x: str, knots: Sequence[float] = WBGT_KNOTS, by: str | None = None) -> dict[str, Column]:
    """``x`` and one hinge per knot, optionally multiplied by column ``by``."""
    value = F.col(x).cast("double")
    out = {x: value}
    for knot in knots:
        out[_knot_name(x, knot)] = F.when(
            value.isNotNull(), F.greatest(value - F.lit(float(knot)), F.lit(0.0))
        )
    if by is None:
        return out
    whole = {f"{by}:{name}": F.col(by).cast("double") * col for name, col in out.items()}
    return Terms(whole, made={f"{by}:{name}": (by, name) for name in out})


def dummies(factor: str, levels: Sequence[str], base: str) -> dict[str, Column]:
    """0/1 columns for every level but the base one."""
    kept = {f"{factor}={level}": level for level in levels if level != base}
    columns = {name: (F.col(factor) == F.lit(level)).cast("double") for name, level in kept.items()}
    return Terms(columns, flags={name: (factor, level) for name, level in kept.items() if isinstance(level, str)})


def product(*parts: dict[str, Column]) -> dict[str, Column]:
    """All products of one column from each part, named ``a:b``."""
    out = Terms()
    for part in parts:
        if not out:
            out = Terms(part)
            continue
        ours, theirs = out.made, getattr(part, "made", {})
        made = {f"{a}:{b}": ours.get(a, (a,)) + theirs.get(b, (b,)) for a in out for b in part}
        out = Terms({f"{a}:{b}": ca * cb for a, ca in out.items() for b, cb in part.items()}, made=made)
    return out


def crossed(*parts: dict[str, Column]) -> dict[str, Column]:
    """Main effects and every product of two or more parts (``a*b*c``)."""
    return Terms(*(product(*(parts[i] for i in chosen)) for size in range(1, len(parts) + 1) for chosen in _subsets(len(parts), size)))


def _subsets(n: int, size: int) -> list[tuple[int, ...]]:
    if size == 0:
        return [()]
    return [(*rest, i) for i in range(n) for rest in _subsets(i, size - 1)]


def cyclic_tents(x: Column, knots: Sequence[float] = DAY_KNOTS) -> dict[str, Column]:
    """Tent functions on a circle; the one at the seam completes the sum to 1."""
    step = float(knots[1] - knots[0])
    inner = {
        f"s{i}": F.greatest(F.lit(1.0) - F.abs(x - F.lit(float(k))) / F.lit(step), F.lit(0.0))
        for i, k in enumerate(knots[1:-1], start=1)
    }
    last = f"s{len(knots) - 2}"
    seam = (
        F.when(x < F.lit(float(knots[1])), F.lit(1.0) - inner["s1"])
        .when(x > F.lit(float(knots[-2])), F.lit(1.0) - inner[last])
        .otherwise(F.lit(0.0))
    )
    return {"s0": seam, **inner}
