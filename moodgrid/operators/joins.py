"""Equi-joins that survive hot keys, lookups, and joins by nearest key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from moodgrid.operators.nearest import LONGEST, grouped
from moodgrid.session import cut_lineage

SMALL_ROWS = 200_000  # rows a lookup may have to be sent to every executor
HOT_SHARE = 0.001  # a key holding more than this share of the rows is salted
SALTS = 64
BANDS = (2, 4)  # edits up to which texts are met by their segments
DIRECT = 100_000  # texts of a group that a task holds
OPEN_TEXTS = 50_000  # open texts of such a group for each copy of its candidates
SALT_KEYS = 500  # open texts of a group for each copy of its candidates


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether the frame has at most ``rows`` rows; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_by: Sequence[str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join a large frame with a lookup whose size is not known beforehand.

    A lookup counted to be small is broadcast, so the fact rows do not move.
    A larger one is joined by ``salted_join``. ``small`` passes on the result
    of an earlier count.
    """
    if is_small(dim) if small is None else small:
        return fact.join(F.broadcast(dim), list(on), how)
    return salted_join(fact, dim, on, how, salt_by)


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Shuffle join in which only the hot keys of the fact side are spread.

    Keys above ``HOT_SHARE`` of the rows (at most 1/HOT_SHARE of them, hence
    safe to broadcast) get copies on the lookup side, one for each ``HOT_SHARE``
    of the rows that a key holds; their fact rows choose a copy by a hash of
    ``salt_by``, which must tell rows of one key apart. Rows with a null in the
    key match nothing and are spread likewise. Every row keeps exactly its own
    matches.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the lookup side is copied, so it cannot be preserved")
    on = list(on)
    spread = list(salt_by) if salt_by else [c for c in fact.columns if c not in on] or on
    counts = fact.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = fact.agg(F.count(F.lit(1)).alias("__all")).scalar()
    pieces = F.ceil(F.col("__n") / (F.lit(HOT_SHARE) * total)).cast("long")
    hot = counts.filter(F.col("__n") > F.lit(HOT_SHARE) * total).select(*on, pieces.alias("__hot"))
    absent = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on))
    parts = F.when(absent, F.lit(int(1 / HOT_SHARE)).cast("long")).otherwise(F.coalesce("__hot", F.lit(1).cast("long")))
    left = fact.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), parts)).drop("__hot")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("__hot", F.lit(1).cast("long")) - 1)
    right = dim.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def merge_many(frames: Sequence[DataFrame], on: Sequence[str], how: str = "inner") -> DataFrame:
    """Fold a list of frames into one by the same keys."""
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def left_chain(base: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left-join every other frame; one shuffle on ``on`` serves all of them."""
    return merge_many([base, *others], on, "left")


def matching(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return df.join(other.select(*on), list(on), "left_semi")


def missing(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    return df.join(other.select(*on), list(on), "left_anti")


def expand_grid(df: DataFrame, values: dict[str, Sequence]) -> DataFrame:
    """Repeat every row for each combination of the listed values."""
    for name, items in values.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in items))))
    return df


def densify(df: DataFrame, key: str, day: str, first: Column, last: Column) -> DataFrame:
    """One row per key and day; days without data carry nulls.

    The day list is generated inside each key's row, so no cross join is
    needed; rows outside the range are kept, as a full outer join keeps them.
    """
    keys = df.select(key).distinct()
    grid = keys.withColumn(day, F.explode(F.sequence(first.cast("date"), last.cast("date"))))
    return grid.join(df, [key, day], "full_outer")


def nearest_key_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], text: str, right_text: str, direct: int = DIRECT
) -> DataFrame:
    """For each left row the right row with equal ``on`` and the closest text.

    Equal texts are settled by an equi-join. The rest meet the texts of their group in
    one task (``nearest``) where these are at most ``direct`` and of at most 64 letters: then
    nothing is exploded. In other groups texts one edit apart meet by joining on
    their one-letter deletions, then the bound k goes through ``BANDS``:
    of k + 1 segments of a text one stays whole under k edits, so texts within k
    share a segment at places at most k apart, and only such pairs are compared.
    Rows open beyond the last band compare themselves with the distinct texts of
    their own ``on`` group, spread by salt and folded to a minimum where they
    arise. Ties take the smallest text, then the smallest row; ``right_text``
    names the matched key. The exploded sides always meet by a shuffle: their size is
    estimated from the rows before the explosion, so they might be broadcast.
    """
    on = list(on)
    keys = left.select(*on, text).distinct()
    values = [c for c in right.columns if c not in (*on, text)]
    rows = right.groupBy(*on, F.col(text).alias("__r")).agg(
        F.min(F.struct(*(F.col(c) for c in values), F.lit(0).alias("__pad"))).alias("__row")
    )
    candidates = rows.filter("__r IS NOT NULL").select(*on, "__r")

    exact = keys.join(
        candidates.withColumn(text, F.col("__r")), [*on, text], "inner"
    ).withColumn("__d", F.lit(0))
    open_keys = keys.join(exact.select(*on, text), [*on, text], "left_anti")

    held = candidates.groupBy(*on).agg(F.count(F.lit(1)).alias("__held"), F.max(F.length("__r")).alias("__long"))
    held = cut_lineage(held.withColumn("__g", F.monotonically_increasing_id()))
    # Texts without a group match nothing.
    sized = cut_lineage(open_keys.join(held, on, "inner"))
    whole = (F.col("__held") <= direct) & (F.greatest("__long", F.length(text)) <= LONGEST)
    found = exact.select(*on, text, "__r", "__d").unionByName(_in_task(sized.filter(whole), candidates, held, on, text))
    apart = sized.filter(~whole).select(*on, text)
    if not apart.isEmpty():
        found = found.unionByName(_by_pieces(apart, candidates, on, text))
    matched = found.join(rows, [*on, "__r"], "inner").select(
        *on,
        text,
        F.col("__r").alias(right_text),
        F.col("__d").alias("edit_distance"),
        *(F.col(f"__row.{c}").alias(c) for c in values),
    )
    return left.join(matched, [*on, text], "left")


def _in_task(open_keys: DataFrame, candidates: DataFrame, held: DataFrame, on: list[str], text: str) -> DataFrame:
    """The closest text of each open one, found where the texts of a group lie together; ``held`` numbers the groups."""
    spark = open_keys.sparkSession
    pieces = F.ceil(F.count(F.lit(1)) / F.lit(OPEN_TEXTS)).cast("long")
    spread = open_keys.groupBy("__g").agg(pieces.alias("__pieces"))
    salt = F.pmod(F.xxhash64(text), F.col("__pieces")).alias("__salt")
    asked = open_keys.join(spread, "__g").select("__g", salt, F.lit(1).alias("__side"), F.col(text).alias("__l"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1)).alias("__salt")
    listed = candidates.join(held.select(*on, "__g"), on).join(spread, "__g")
    listed = listed.select("__g", copies, F.lit(0).alias("__side"), F.col("__r").alias("__l"))
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = asked.unionByName(listed).repartition(parts, "__g", "__salt").sortWithinPartitions("__g", "__salt", "__side", "__l")
    schema = StructType(
        [StructField("__g", LongType()), StructField(text, StringType()), StructField("__r", StringType()), StructField("__d", IntegerType())]
    )
    found = cut_lineage(dealt.mapInArrow(grouped(to_arrow_schema(schema)), schema))
    return found.join(held.select(*on, "__g"), "__g").select(*on, text, "__r", "__d")


def _by_pieces(open_keys: DataFrame, candidates: DataFrame, on: list[str], text: str) -> DataFrame:
    """The closest text of each open one, by joins on deletions and segments, then on the whole group."""

    def deletions(col: str) -> Column:
        size = F.length(col)
        cut = F.transform(
            F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")),
            lambda i: F.concat(F.substring(F.col(col), F.lit(1), i - 1), F.substring(F.col(col), i + 1, size)),
        )
        return F.array_distinct(F.concat(F.array(F.col(col)), cut))

    one_left = open_keys.withColumn("__v", F.explode(deletions(text)))
    one_right = candidates.withColumn("__v", F.explode(deletions("__r")))
    one_edit = (
        one_left.join(one_right.hint("merge"), [*on, "__v"], "inner")
        .withColumn("__d", F.levenshtein(F.col(text), F.col("__r")))
        .filter(F.col("__d") == 1)
    )
    near = cut_lineage(_closest(one_edit, on, text))
    open_keys = cut_lineage(open_keys.join(near.select(*on, text), [*on, text], "left_anti"))
    for k in BANDS:
        if open_keys.isEmpty():
            break
        banded = cut_lineage(_closest(_within(open_keys, candidates, on, text, k), on, text))
        near = near.unionByName(banded)
        open_keys = cut_lineage(open_keys.join(banded.select(*on, text), [*on, text], "left_anti"))

    salts = F.least(F.lit(SALTS), F.ceil(F.count(F.lit(1)) / F.lit(SALT_KEYS))).cast("long")
    spread = open_keys.groupBy(*on).agg(salts.alias("__salts"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))
    far_pairs = (
        open_keys.join(spread, on, "inner")
        .withColumn("__salt", F.pmod(F.xxhash64(text), F.col("__salts")))
        .drop("__salts")
        .join(
            candidates.join(spread, on, "inner").withColumn("__salt", copies).drop("__salts").hint("merge"),
            [*on, "__salt"],
            "inner",
        )
        .withColumn("__d", F.levenshtein(F.col(text), F.col("__r")))
    )
    return near.unionByName(_closest(far_pairs, on, text))


def _within(left: DataFrame, right: DataFrame, on: list[str], text: str, k: int) -> DataFrame:
    """Pairs of texts at most ``k`` edits apart, with their distance ``__d``.

    A text of m letters has k + 1 segments of m div (k + 1) letters, the last m mod
    (k + 1) of them one letter longer.
    """
    size = f"(m DIV {k + 1} + IF(i >= {k + 1} - m % {k + 1}, 1, 0))"
    start = f"(i * (m DIV {k + 1}) + greatest(i - ({k + 1} - m % {k + 1}), 0))"
    whole = f"transform(sequence(0, {k}), i -> named_struct('m', m, 'i', i, 's', substring(__r, {start} + 1, {size})))"
    filed = right.withColumn("m", F.length("__r")).withColumn("__p", F.explode(F.expr(whole))).select(*on, "__r", "__p")
    # Where a segment of a text of m letters may stand in this one.
    first, last = f"greatest({start} - {k}, 0)", f"least({start} + {k}, n - {size})"
    places = f"transform(IF({last} < {first}, array(), sequence({first}, {last})), p -> named_struct('m', m, 'i', i, 's', substring(__l, p + 1, {size})))"
    parts = f"array_distinct(flatten(flatten(transform(sequence(greatest(n - {k}, 0), n + {k}), m -> transform(sequence(0, {k}), i -> {places})))))"
    asked = left.withColumns({"__l": F.col(text), "n": F.length(text)}).withColumn("__p", F.explode(F.expr(parts))).drop("__l", "n")
    pairs = asked.join(filed.hint("merge"), [*on, "__p"], "inner").select(*on, text, "__r").distinct()
    return pairs.withColumn("__d", F.levenshtein(F.col(text), F.col("__r"), k)).filter(F.col("__d") >= 0)


def _closest(pairs: DataFrame, on: list[str], text: str) -> DataFrame:
    best = pairs.groupBy(*on, text).agg(F.min(F.struct("__d", "__r")).alias("__b"))
    return best.select(*on, text, F.col("__b.__r").alias("__r"), F.col("__b.__d").alias("__d"))
