"""Sentiment and vocabulary operators over post texts.

Words are exploded and meet the lexicon in a broadcast hash join; the scores
fold back per post inside each task before the one shuffle on the post key.
Rows with equal keys are copies of one post and yield one result row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.functions import tokens as tk
from moodgrid.operators.joins import is_small, lookup_join

# Weights of the published polarity rules.
BOOST = 0.293
CAPITALS = 0.733
NEGATE = -0.74
EXCLAIM = 0.292
QUESTION = 0.18
QUESTION_MANY = 0.96
NORMAL = 15.0
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
# Bytes of text that a task scores.
TASK_TEXT = 16 << 20
# A word with its inner apostrophes and hyphens.
RULE_WORD = r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*"


def clean_text(df: DataFrame, text: str, out: str = "clean_text", emoji_names: DataFrame | None = None) -> DataFrame:
    """Emoji spelled out as ``:name:``, links and unnamed emoji removed.

    ``emoji_names`` (emoji, name) must fit one row; each text only looks up
    the distinct emoji it holds.
    """
    spelled = F.col(text)
    if emoji_names is not None:
        if not is_small(emoji_names, 10_000):
            raise ValueError("the emoji table has more rows than there are emoji")
        named = emoji_names.agg(F.map_from_entries(F.collect_list(F.struct("emoji", "name")))).scalar()
        df = df.withColumn("__names", named)
        found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(tk.EMOJI), F.lit(0)))
        spelled = F.aggregate(
            found,
            F.col(text),
            lambda acc, e: F.replace(acc, e, F.coalesce(F.concat(F.lit(":"), F.col("__names")[e], F.lit(":")), e)),
        )
    return df.withColumn(out, tk.strip_links(spelled)).drop("__names")


def explode_tokens(df: DataFrame, keys: Sequence[str], text: str, word: str = "word") -> DataFrame:
    """One row per token, with the token count of its text as ``n_tokens``."""
    split = df.filter(F.col(text).isNotNull()).select(*keys, tk.tokenize(F.col(text)).alias("__t"))
    return split.select(*keys, F.size("__t").alias("n_tokens"), F.explode("__t").alias(word))


def lexicon_scores(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    lexicon: DataFrame,
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
    delta: float = 0.0,
) -> DataFrame:
    """Several word-list scores in one pass over the words.

    ``lexicon`` holds ``word`` and one column per list. A sum score is divided
    by the root of the token count; a mean score is taken over listed words at
    least ``delta`` away from the neutral 5 and is null without any.
    """
    lists = list(dict.fromkeys([*sums, *means]))
    words = explode_tokens(over_cores(df, text), keys, text)
    scored = lookup_join(words, lexicon.select("word", *lists), ["word"], "left", salt_by=keys)
    n, rows = F.max("n_tokens"), F.count(F.lit(1))
    aggs = []
    for c in sums:
        total = F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
        aggs.append((total * n / rows / F.sqrt(n)).alias(c))
    for c in means:
        far = (F.col(c) >= 5.0 + delta) | (F.col(c) <= 5.0 - delta)
        aggs.append(F.avg(F.when(far, F.col(c).cast("double"))).alias(c))
    return scored.groupBy(*keys).agg(*aggs)


def lexicon_sum_sqrt(df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame, out: str = "afinn") -> DataFrame:
    return lexicon_scores(df, keys, text, lexicon.withColumnRenamed("score", out), sums=[out])


def lexicon_mean(
    df: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame, delta: float = 0.0, out: str = "hedono"
) -> DataFrame:
    return lexicon_scores(df, keys, text, lexicon.withColumnRenamed("score", out), means=[out], delta=delta)


def word_frequency(df: DataFrame, text: str) -> DataFrame:
    """Share of each word among all words."""
    counts = explode_tokens(df, [], text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n").alias("t")).scalar())


def over_cores(df: DataFrame, text: str) -> DataFrame:
    """Files dealt into tasks of ``TASK_TEXT`` bytes of text, one a core at least: texts cost far more to score than to move."""
    files = 0 if df.isStreaming else len(df.inputFiles())
    if not files:
        return df
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT))
    return df.repartition(parts) if files < parts else df


def word_shift(df: DataFrame, side: str, sides: tuple[str, str], text: str, lexicon: DataFrame, delta: float = 0.0) -> DataFrame:
    """Each word's part in the difference of mean happiness of two samples.

    ``sides`` names the reference and the comparison sample. Returns abundance
    difference, happiness relative to the reference mean and percent of the
    total shift, in ascending order of magnitude.
    """
    words = explode_tokens(df.filter(F.col(side).isin(*sides)), [side], text)
    far = (F.col("score") >= 5.0 + delta) | (F.col("score") <= 5.0 - delta)
    counts = (
        lookup_join(words.groupBy(side, "word").agg(F.count(F.lit(1)).alias("n")), lexicon, ["word"], "inner")
        .filter(far)
    )
    is_ref, is_comp = F.col(side) == sides[0], F.col(side) == sides[1]
    wide = counts.groupBy("word").agg(
        F.sum(F.when(is_ref, F.col("n"))).alias("ref_n"),
        F.sum(F.when(is_comp, F.col("n"))).alias("comp_n"),
        F.max("score").alias("score"),
    )

    def total(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")))

    def happiness(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n") * F.col("score"))) / total(which)

    overall = counts.agg(
        F.struct(
            total(is_ref).alias("ref_n"),
            total(is_comp).alias("comp_n"),
            happiness(is_ref).alias("ref_mean"),
            happiness(is_comp).alias("comp_mean"),
        ).alias("o")
    ).scalar()
    abundance = F.coalesce(F.col("comp_n"), F.lit(0)) / F.col("o.comp_n") - F.coalesce(
        F.col("ref_n"), F.lit(0)
    ) / F.col("o.ref_n")
    relative = F.col("score") - F.col("o.ref_mean")
    return (
        wide.withColumn("o", overall)
        .select(
            "word",
            (relative * abundance * F.lit(100.0) / (F.col("o.comp_mean") - F.col("o.ref_mean"))).alias("percent"),
            abundance.alias("abundance"),
            relative.alias("happiness"),
        )
        .orderBy(F.abs("percent"), "word")
    )


def rule_polarity(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    lexicon: DataFrame,
    boosters: DataFrame,
    negations: Sequence[str],
    out: str = "vader",
) -> DataFrame:
    """Rule-based compound polarity in -1..1.

    Listed words are weighed by the three words before them (degree words,
    negations), by capitals, and by their side of a "but"; exclamation and
    question marks strengthen the sum. ``boosters`` has ``word`` and ``step``
    (positive strengthens). Texts without a listed word score 0.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(RULE_WORD), F.lit(0))
    base = over_cores(df, text).filter(F.col(text).isNotNull()).select(
        *keys,
        found.alias("__w"),
        F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(4)).alias("__ex"),
        (F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))).alias("__qu"),
    )

    def shouted(w: Column) -> Column:
        return (F.upper(w) == w) & (F.lower(w) != w)

    mixed = F.exists("__w", shouted) & F.exists("__w", lambda w: ~shouted(w))
    lowered = F.transform("__w", lambda w: F.lower(w))
    marked = base.select(
        *keys, "__w", "__ex", "__qu", mixed.alias("__mixed"), F.array_position(lowered, "but").alias("__but")
    )
    # The window of three predecessors is taken inside the row, before exploding.
    context = F.transform(
        "__w",
        lambda w, i: F.struct(
            w.alias("w"),
            (i + 1).alias("at"),
            *(F.get(F.col("__w"), i - j).alias(f"p{j}") for j in (1, 2, 3)),
        ),
    )
    words = marked.select(*keys, "__ex", "__qu", "__mixed", "__but", F.explode_outer(context).alias("__c")).select(
        *keys, "__ex", "__qu", "__mixed", "__but", "__c.*"
    )
    words = words.withColumn("word", F.lower("w"))
    # One table tells for every word whether it is listed and how it modifies;
    # a listed word never acts as a modifier.
    listed = lexicon.select("word", F.lit(True).alias("listed"))
    steps_of = boosters.select("word", F.col("step").cast("double").alias("step"))
    modifiers = listed.join(steps_of, ["word"], "full_outer").withColumn(
        "step", F.when(F.col("listed").isNull(), F.col("step"))
    )
    small = is_small(modifiers)
    scored = lookup_join(words, lexicon.select("word", "score"), ["word"], "left", salt_by=keys, small=small)
    for j in (1, 2, 3):
        # Only scored words need their context.
        scored = scored.withColumn(f"l{j}", F.when(F.col("score").isNotNull(), F.lower(f"p{j}")))
        before = modifiers.select(*(F.col(c).alias(f"{c}{j}") for c in modifiers.columns))
        scored = lookup_join(
            scored, before.withColumnRenamed(f"word{j}", f"l{j}"), [f"l{j}"], "left", salt_by=keys, small=small
        )

    sign = F.when(F.col("score") > 0, F.lit(1.0)).when(F.col("score") < 0, F.lit(-1.0)).otherwise(F.lit(0.0))
    value = F.col("score").cast("double") + F.when(
        F.col("__mixed") & shouted(F.col("w")), sign * F.lit(CAPITALS)
    ).otherwise(F.lit(0.0))
    steps = []
    for j, damping in zip((1, 2, 3), DISTANCE_DAMPING, strict=True):
        step = F.coalesce(F.col(f"step{j}"), F.lit(0.0))
        loud = F.when(
            F.col("__mixed") & shouted(F.col(f"p{j}")) & (step != 0), F.signum(step) * F.lit(CAPITALS)
        ).otherwise(F.lit(0.0))
        weight = (step + loud) * F.lit(damping)
        denies = F.coalesce(
            F.col(f"listed{j}").isNull()
            & (F.col(f"l{j}").isin(*negations) | F.col(f"l{j}").endswith("n't")),
            F.lit(False),
        )
        steps.append((weight, denies))
    for weight, denies in steps:
        # Each step names the value once: named twice it doubles with each, beyond what the JVM compiles.
        value = (value + sign * weight) * F.when(denies, F.lit(NEGATE)).otherwise(F.lit(1.0))
    value = value * F.when(F.col("__but") == 0, F.lit(1.0)).when(F.col("at") < F.col("__but"), F.lit(BEFORE_BUT)).when(
        F.col("at") > F.col("__but"), F.lit(AFTER_BUT)
    ).otherwise(F.lit(1.0))

    copies = F.count_if(F.coalesce(F.col("at"), F.lit(1)) == 1)
    folded = scored.withColumn("__v", F.coalesce(value, F.lit(0.0))).groupBy(*keys).agg(
        (F.sum("__v") / copies).alias("s"), F.max("__ex").alias("ex"), F.max("__qu").alias("qu")
    )
    emphasis = F.col("ex") * F.lit(EXCLAIM) + F.when(F.col("qu") > 3, F.lit(QUESTION_MANY)).when(
        F.col("qu") > 1, F.col("qu") * F.lit(QUESTION)
    ).otherwise(F.lit(0.0))
    total = F.col("s") + F.signum("s") * emphasis
    return folded.select(*keys, (total / F.sqrt(total * total + F.lit(NORMAL))).alias(out))


def pos_lexicon_score(
    tokens: DataFrame,
    keys: Sequence[str],
    lexicon: DataFrame,
    parts: Sequence[str] = ("n", "adj", "adv"),
    how: str = "mean",
    out: str = "score",
) -> DataFrame:
    """Mean or sum over tagged tokens of the listed parts of speech.

    ``tokens`` and ``lexicon`` share ``term`` and ``pos``; an unlisted token
    counts as 0, a text without such tokens scores 0.
    """
    scored = lookup_join(tokens, lexicon.withColumnRenamed("score", "__s"), ["term", "pos"], "left", salt_by=keys)
    used = F.col("pos").isin(*parts)
    total = F.coalesce(F.sum(F.when(used, F.col("__s"))).cast("double"), F.lit(0.0))
    result = total if how == "sum" else total / F.greatest(F.count_if(used), F.lit(1))
    return scored.groupBy(*keys).agg(result.alias(out))


def language_profile(df: DataFrame, lang: str, names: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent languages, their share of all rows and their names.

    ``names`` has ``lang_code`` and ``lang_name``; others are 'Unknown'.
    """
    counts = df.groupBy(F.col(lang).alias("lang_code")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    top = counts.withColumn("portion", F.col("n") / total).orderBy(F.desc("n"), F.asc("lang_code")).limit(k)
    return top.join(names, ["lang_code"], "left").withColumn(
        "lang_name", F.coalesce(F.col("lang_name"), F.lit("Unknown"))
    )


def char_budget(df: DataFrame, file: str, lang: str, text: str, home: str = "en") -> DataFrame:
    """Characters of cleaned foreign text: total, files with any, mean per such file."""
    chars = F.when(F.col(lang) != home, tk.non_newline_chars(tk.strip_links(F.col(text)))).otherwise(F.lit(0))
    per_file = df.groupBy(file).agg(F.coalesce(F.sum(chars), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("r"))
    used = F.count_if(F.col("c") > 0)
    return per_file.agg(
        F.sum("c").alias("total_chars"),
        used.alias("files"),
        F.when(used > 0, F.sum("c") / used).alias("chars_per_file"),
        F.sum("r").alias("records"),
    )


def score_all(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    lexicon: DataFrame,
    weather_terms: Sequence[str],
    boosters: DataFrame,
    negations: Sequence[str],
    depressive_terms: Sequence[str] = tk.DEPRESSIVE_TERMS,
    emoji_names: DataFrame | None = None,
) -> DataFrame:
    """All scores and flags per post; the text itself is dropped.

    ``lexicon`` holds ``word``, ``afinn``, ``hedono`` and ``valence``. Scores
    come from the text as posted, the weather flag from the cleaned text.
    """
    present = df.filter(F.col(text).isNotNull())
    flagged = clean_text(over_cores(present, text), text, "__clean", emoji_names)
    flags = flagged.groupBy(*keys).agg(
        F.max(tk.has_term(F.col("__clean"), weather_terms)).alias("weather_term"),
        F.max(tk.has_term(F.col(text), depressive_terms)).alias("depress_term"),
    )
    lists = lexicon_scores(present, keys, text, lexicon, sums=["afinn"], means=["hedono"])
    valence = lexicon.filter(F.col("valence").isNotNull()).select("word", F.col("valence").alias("score"))
    rules = rule_polarity(present, keys, text, valence, boosters, negations)
    return flags.join(lists, list(keys), "left").join(rules, list(keys), "left")
