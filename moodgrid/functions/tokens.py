"""Tokens and text cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters of every script; the ASCII class would cut accented letters.
NON_WORD = r"[^\p{L}\p{N}_]+"
# Penn-style words: letters, digits, inner apostrophes and hyphens kept together.
SURFACE_WORD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
URL = r"(?i)\b(?:https?://|www\.)\S+"
EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}]"

# Vocabulary of depressive language.
DEPRESSIVE_TERMS = (
    "addictive alone anxiety appetite attacks bleak depress depressed depression drowsiness "
    "episodes fatigue frightened lonely nausea nervousness severe sleep suicidal suicide trapped"
).split(" ")


def tokenize(text: Column) -> Column:
    """Lower-case pieces between runs of non-word characters, empty edges kept."""
    return F.split(F.lower(text), NON_WORD)


def surface_words(text: Column) -> Column:
    """Words as written, without punctuation."""
    return F.regexp_extract_all(text, F.lit(SURFACE_WORD), F.lit(0))


def has_term(text: Column, terms: Sequence[str]) -> Column:
    """1 if any word equals a listed term (case matters), else 0."""
    listed = F.array(*(F.lit(t) for t in terms))
    return F.when(text.isNotNull(), F.arrays_overlap(surface_words(text), listed).cast("int"))


def strip_links(text: Column) -> Column:
    """Text without links and emoji."""
    bare = F.regexp_replace(F.regexp_replace(text, URL, ""), EMOJI, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def non_newline_chars(text: Column) -> Column:
    """Characters other than line breaks."""
    return F.length(F.regexp_replace(text, "\n", ""))
