"""Text queries (inventory T1 to T12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodgrid.functions import tokens as tk
from moodgrid.operators import text as ops
from moodgrid.queries.fixtures import literal_rows
from moodgrid.queries.registry import query, r, rounded

NON_WORD = r"[^\p{L}\p{N}_]+"
TOKENS = f"regexp_split_to_array(lower(text), '{NON_WORD}')"
# Words of the given texts that stand for a flag vocabulary.
FLAG_TERMS = ("storm", "rain", "weather", "thing", "Thing", "entre", "wind", "dition", "sonne", "regen", "erest")
LANGUAGES = (("en", "English"), ("fr", "French"), ("de", "German"))
BOOSTERS = (("very", 0.293), ("the", 0.293), ("of", -0.293), ("de", 0.293), ("and", 0.293))
NEGATIONS = ("not", "no", "never", "in", "la")
EMOJI = (("❤", "red_heart"), ("☀", "sun"))

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace({t}, '(?i)\b(https?://|www\.)\S+', '', 'g'),
   '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]', '', 'g'), '\s+', ' ', 'g'))"""


@query(
    "T1_clean_text",
    "SELECT doc_id, "
    + CLEAN.replace("{t}", "replace(replace(t, '❤', ':red_heart:'), '☀', ':sun:')")
    + """ AS clean_text FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' ❤ https://t.co/' || doc_id
         WHEN doc_id % 3 = 1 THEN '☀☁ www.x.org/a b' ELSE '' END AS t FROM documents) d""",
)
def _(t):
    tail = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ❤ https://t.co/"), F.col("doc_id").cast("string")))
        .when(F.col("doc_id") % 3 == 1, F.lit("☀☁ www.x.org/a b"))
        .otherwise(F.lit(""))
    )
    docs = t.documents.select("doc_id", F.concat("text", tail).alias("text"))
    names = literal_rows(t, EMOJI, "emoji string, name string")
    return ops.clean_text(docs, "text", emoji_names=names).select("doc_id", "clean_text")


TERM_LIST = ", ".join(f"'{w}'" for w in FLAG_TERMS)


@query(
    "T2_has_term",
    rf"""SELECT doc_id, cast(list_has_any(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:-[\p{{L}}\p{{N}}_]+)*'), [{TERM_LIST}]) AS int) AS flag
        FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", tk.has_term(F.col("text"), FLAG_TERMS).alias("flag"))


@query("T3_tokenize", f"SELECT doc_id, unnest({TOKENS}) AS word FROM documents")
def _(t):
    return t.documents.select("doc_id", F.explode(tk.tokenize(F.col("text"))).alias("word"))


TOKEN_ROWS = f"SELECT doc_id, unnest(ws) AS word, len(ws) AS n FROM (SELECT doc_id, {TOKENS} AS ws FROM documents) d"


@query(
    "T4_lexicon_sum_sqrt",
    f"""SELECT doc_id, {r('coalesce(sum(afinn), 0) / sqrt(max(n))')} AS afinn
        FROM ({TOKEN_ROWS}) k LEFT JOIN lexicon USING (word) GROUP BY doc_id""",
    ("lexicon",),
)
def _(t):
    lex = t.lexicon.select("word", F.col("afinn").alias("score"))
    return rounded(ops.lexicon_sum_sqrt(t.documents, ["doc_id"], "text", lex))


@query(
    "T5_lexicon_mean",
    f"""SELECT doc_id, {r('avg(CASE WHEN hedono >= 6 OR hedono <= 4 THEN hedono END)')} AS hedono
        FROM ({TOKEN_ROWS}) k LEFT JOIN lexicon USING (word) GROUP BY doc_id""",
    ("lexicon",),
)
def _(t):
    lex = t.lexicon.select("word", F.col("hedono").alias("score"))
    return rounded(ops.lexicon_mean(t.documents, ["doc_id"], "text", lex, delta=1.0))


@query(
    "T6_word_frequency",
    f"""SELECT word, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 9)} AS share
        FROM ({TOKEN_ROWS}) k GROUP BY word""",
)
def _(t):
    return rounded(ops.word_frequency(t.documents, "text"), 9)


@query(
    "T7_word_shift",
    f"""WITH c AS (SELECT lang, word, any_value(hedono) AS score, count(*) AS n
                   FROM (SELECT lang, unnest({TOKENS}) AS word FROM documents WHERE lang IN ('en', 'fr')) k
                   JOIN lexicon USING (word) WHERE hedono >= 6 OR hedono <= 4 GROUP BY lang, word),
             o AS (SELECT sum(n) FILTER (lang = 'en') AS rn, sum(n) FILTER (lang = 'fr') AS cn,
                          sum(n * score) FILTER (lang = 'en') / sum(n) FILTER (lang = 'en') AS rm,
                          sum(n * score) FILTER (lang = 'fr') / sum(n) FILTER (lang = 'fr') AS cm FROM c),
             w AS (SELECT word, any_value(score) AS score, coalesce(sum(n) FILTER (lang = 'en'), 0) AS rn,
                          coalesce(sum(n) FILTER (lang = 'fr'), 0) AS cn FROM c GROUP BY word)
        SELECT word, {r('(score - rm) * (w.cn / o.cn - w.rn / o.rn) * 100 / (cm - rm)')} AS percent,
               {r('w.cn / o.cn - w.rn / o.rn')} AS abundance, {r('score - rm')} AS happiness FROM w, o""",
    ("lexicon",),
)
def _(t):
    lex = t.lexicon.select("word", F.col("hedono").alias("score"))
    return rounded(ops.word_shift(t.documents, "lang", ("en", "fr"), "text", lex, delta=1.0))


VALENCE = "(SELECT word, valence AS score FROM lexicon)"
BOOST_ROWS = "(VALUES " + ", ".join(f"('{w}', {s * 1000:.0f}e-3)" for w, s in BOOSTERS) + ") AS boosters(word, step)"
NEGATION_LIST = ", ".join(f"'{w}'" for w in NEGATIONS)


def polarity_sql(table: str, key: str, text: str) -> str:
    word = r"[\p{L}\p{N}_]+(?:[''’\-][\p{L}\p{N}_]+)*"
    levels = []
    for j, damp in ((1, "1e0"), (2, "95e-2"), (3, "9e-1")):
        levels.append(
            f"""s{j} AS (SELECT *, (valence{j - 1} + sgn * (step{j} + CASE WHEN mixed AND loud{j} AND step{j} <> 0
                 THEN sign(step{j}) * 733e-3 ELSE 0 END) * {damp}) * CASE WHEN denies{j} THEN -74e-2 ELSE 1 END AS valence{j}
                 FROM {'c' if j == 1 else f's{j - 1}'})"""
        )
    prev = ", ".join(f"ws[i - {j}] AS p{j}" for j in (1, 2, 3))
    guard = ", ".join(f"CASE WHEN i > {j} THEN p{j} END AS q{j}" for j in (1, 2, 3))
    looked = ", ".join(
        f"""CASE WHEN l{j}.word IS NULL THEN coalesce(b{j}.step, 0) ELSE 0 END AS step{j},
            coalesce(upper(q{j}) = q{j} AND lower(q{j}) <> q{j}, false) AS loud{j},
            coalesce(l{j}.word IS NULL AND (lower(q{j}) IN ({NEGATION_LIST}) OR lower(q{j}) LIKE '%n''t'), false) AS denies{j}"""
        for j in (1, 2, 3)
    )
    joins = " ".join(
        f"LEFT JOIN {VALENCE} l{j} ON l{j}.word = lower(q{j}) LEFT JOIN (SELECT * FROM {BOOST_ROWS}) b{j} ON b{j}.word = lower(q{j})"
        for j in (1, 2, 3)
    )
    shouts = "len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x))"
    return f"""WITH base AS (SELECT {key}, regexp_extract_all({text}, '{word}') AS ws,
           least(length({text}) - length(replace({text}, '!', '')), 4) AS ex,
           length({text}) - length(replace({text}, '?', '')) AS qu FROM {table}),
      m AS (SELECT *, {shouts} > 0 AND {shouts} < len(ws) AS mixed,
                   coalesce(list_position(list_transform(ws, lambda x: lower(x)), 'but'), 0) AS but FROM base),
      u AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM m),
      g AS (SELECT {key}, mixed, but, i, w, lower(w) AS word, {guard} FROM (SELECT *, ws[i] AS w, {prev} FROM u) z),
      c AS (SELECT g.*, lx.score, sign(lx.score) AS sgn, {looked},
                   lx.score + CASE WHEN mixed AND upper(w) = w AND lower(w) <> w THEN sign(lx.score) * 733e-3 ELSE 0 END AS valence0
            FROM g JOIN {VALENCE} lx ON lx.word = g.word {joins}),
      {', '.join(levels)},
      f AS (SELECT {key}, sum(valence3 * CASE WHEN but = 0 OR i = but THEN 1e0 WHEN i < but THEN 5e-1 ELSE 15e-1 END) AS s
            FROM s3 GROUP BY {key}),
      e AS (SELECT m.{key}, coalesce(s, 0) AS s, ex * 292e-3 + CASE WHEN qu > 3 THEN 96e-2 WHEN qu > 1 THEN qu * 18e-2 ELSE 0 END AS em
            FROM m LEFT JOIN f USING ({key}))
      SELECT {key}, {r('(s + sign(s) * em) / sqrt((s + sign(s) * em) * (s + sign(s) * em) + 15)')} AS vader FROM e"""


def booster_frame(t):
    return literal_rows(t, BOOSTERS, "word string, step double")


@query("T8_rule_polarity", polarity_sql("documents", "doc_id", "text"), ("lexicon",))
def _(t):
    lex = t.lexicon.select("word", F.col("valence").alias("score"))
    return rounded(ops.rule_polarity(t.documents, ["doc_id"], "text", lex, booster_frame(t), NEGATIONS))


POS = "CASE length(word) % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'adj' WHEN 2 THEN 'v' ELSE 'adv' END"


@query(
    "T9_pos_lexicon_mean",
    f"""SELECT doc_id, {r("coalesce(sum(CASE WHEN k.pos <> 'v' THEN coalesce(score, 0) END) / nullif(count(*) FILTER (k.pos <> 'v'), 0), 0)")} AS score
        FROM (SELECT doc_id, word AS term, {POS} AS pos FROM ({TOKEN_ROWS}) a) k
        LEFT JOIN (SELECT word AS term, 'n' AS pos, afinn AS score FROM lexicon UNION ALL
                   SELECT word, 'adj', hedono - 5 FROM lexicon) x ON x.term = k.term AND x.pos = k.pos GROUP BY doc_id""",
    ("lexicon",),
)
def _(t):
    tokens = ops.explode_tokens(t.documents, ["doc_id"], "text", "term").selectExpr(
        "doc_id", "term", f"{POS.replace('word', 'term')} AS pos"
    )
    lex = t.lexicon.selectExpr("word AS term", "'n' AS pos", "cast(afinn AS double) AS score").unionByName(
        t.lexicon.selectExpr("word AS term", "'adj' AS pos", "hedono - 5 AS score")
    )
    return rounded(ops.pos_lexicon_score(tokens, ["doc_id"], lex))


@query(
    "T9_pos_lexicon_sum",
    f"""SELECT doc_id, {r("coalesce(sum(CASE WHEN pos = 'n' THEN afinn END), 0)")} AS score
        FROM (SELECT doc_id, word, {POS} AS pos FROM ({TOKEN_ROWS}) a) k LEFT JOIN lexicon USING (word) GROUP BY doc_id""",
    ("lexicon",),
)
def _(t):
    tokens = ops.explode_tokens(t.documents, ["doc_id"], "text", "term").selectExpr(
        "doc_id", "term", f"{POS.replace('word', 'term')} AS pos"
    )
    lex = t.lexicon.selectExpr("word AS term", "'n' AS pos", "cast(afinn AS double) AS score")
    return rounded(ops.pos_lexicon_score(tokens, ["doc_id"], lex, how="sum"))


@query(
    "T10_language_profile",
    f"""SELECT lang AS lang_code, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS portion,
               CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Unknown' END AS lang_name
        FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 20""",
)
def _(t):
    names = literal_rows(t, LANGUAGES, "lang_code string, lang_name string")
    return rounded(ops.language_profile(t.documents, "lang", names))


@query(
    "T11_char_budget",
    f"""SELECT cast(sum(c) AS bigint) AS total_chars, count(*) FILTER (c > 0) AS files,
               {r('sum(c) / count(*) FILTER (c > 0)')} AS chars_per_file, cast(sum(k) AS bigint) AS records
        FROM (SELECT source, sum(CASE WHEN lang <> 'en' THEN length({CLEAN.replace('{t}', 'text')}) ELSE 0 END) AS c, count(*) AS k
              FROM documents GROUP BY source) s""",
)
def _(t):
    return rounded(ops.char_budget(t.documents, "source", "lang", "text"))


DEPRESSIVE_SQL = """'addictive', 'alone', 'anxiety', 'appetite', 'attacks', 'bleak', 'depress', 'depressed', 'depression', 'drowsiness',
  'episodes', 'fatigue', 'frightened', 'lonely', 'nausea', 'nervousness', 'severe', 'sleep', 'suicidal', 'suicide', 'trapped'"""


@query(
    "T12_score_all",
    f"""WITH v AS ({polarity_sql('posts', 'id', 'pure_text')}),
        k AS (SELECT id, unnest(ws) AS word, len(ws) AS n FROM (SELECT id, {TOKENS.replace('text', 'pure_text')} AS ws FROM posts) d),
        a AS (SELECT id, {r('coalesce(sum(afinn), 0) / sqrt(max(n))')} AS afinn, {r('avg(hedono)')} AS hedono
              FROM k LEFT JOIN lexicon USING (word) GROUP BY id)
        SELECT p.id, p.tweet_created_at,
          cast(list_has_any(regexp_extract_all({CLEAN.replace('{t}', 'pure_text')}, '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*'), [{TERM_LIST}]) AS int) AS weather_term,
          cast(list_has_any(regexp_extract_all(pure_text, '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*'),
               [{DEPRESSIVE_SQL}]) AS int) AS depress_term, afinn, hedono, vader
        FROM posts p LEFT JOIN a USING (id) LEFT JOIN v USING (id)""",
    ("posts", "lexicon"),
)
def _(t):
    return rounded(
        ops.score_all(
            t.posts, ["id", "tweet_created_at"], "pure_text", t.lexicon, FLAG_TERMS, booster_frame(t), NEGATIONS
        )
    )
