r"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

Everything is a column expression. A pattern's matches come from
``regexp_extract_all``, the text between them from ``split`` with the same
pattern; the lengths of both, summed from the left, are the code point offsets.
The patterns are the plain ones of the contract, written so that a matcher never
goes back over a run it has seen: possessive repeats, and no start inside a run
that the same match would have begun at (``\G`` allows a start right after a match).

Base kinds (email, ip, card, phone) stay whatever the context says. The added
kinds have to reach ``ACCEPT``: an IBAN by its mod-97 check, a national number by
a context word before it. Added spans do not overlap base ones.

Nulls: a null text is an empty one, a null key stays null. Rows that repeat come
back each. An empty table gives an empty result. A clashing input column is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.llm.common import text_or_empty

ACCEPT = 0.6
NEAR = 48
BONUS = 0.35
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # what a text has to hold before the pattern is tried
    context: str  # words that speak for the kind, in the text before it
    score: float


BASE = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        "mail|contact|courriel|correo",
        0.9,
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|address|server|host", 0.65),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", "card|credit|visa|karte|carte|tarjeta|payment", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|tel|call|mobile|fax|contact", 0.7),
)
ADDED = (
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+\b", "", "iban|konto|account|bank", 0.85),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", r"\bssn\b|social security|\bsin\b", 0.3),
    Kind(
        "local_phone",
        r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        "",
        r"phone|\btel\b|call me|call us|mobile|\bfax\b|appel|anruf",
        0.3,
    ),
)
FOUND = "array<struct<start:int,end:int,hit:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    """ISO 7064: the first four characters go to the end, letters count from ten."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda at, c: F.when(c >= "A", (at * 100 + F.ascii(c) - 55) % 97).otherwise((at * 10 + F.ascii(c) - 48) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _valid(kind: str, hit: Column) -> Column:
    """What the checksum or the bounds of a kind say; looked at for matches only."""
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(hit)
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    if kind == "iban":
        return _mod97(hit)
    return F.lit(True)


def _located(text: Column, kind: Kind) -> Column:
    """Every match of a kind with its code point offsets, in order, unchecked."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast(FOUND)

    def offsets(hits: Column) -> Column:
        gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
        summed = F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("at"), none.alias("found")),
            lambda acc, p: F.struct(
                (acc.at + p.gap + F.length(p.hit)).alias("at"),
                F.concat(
                    acc.found,
                    F.array(
                        F.struct(
                            (acc.at + p.gap).alias("start"),
                            (acc.at + p.gap + F.length(p.hit)).alias("end"),
                            p.hit.alias("hit"),
                        )
                    ),
                ).cast(FOUND).alias("found"),
            ),
        )
        return F.when(F.size(hits) == 0, none).otherwise(summed.found)

    found = F.element_at(F.transform(F.array(hits), offsets), 1)
    return F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(none) if kind.hint else found


def _spans(text: Column, kind: Kind, rank: int, located: Column) -> Column:
    """Confirmed spans with their score: the kind's own, more if a context word stands before."""

    def span(f: Column) -> Column:
        from_ = F.greatest(f.start - NEAR, F.lit(0))
        before = F.lower(F.substring(text, from_ + 1, f.start - from_))
        score = F.lit(kind.score) + F.when(before.rlike(kind.context), F.lit(BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            f.start.alias("start"),
            F.lit(rank).alias("rank"),
            f.end.alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(score, F.lit(1.0)).alias("score"),
        )

    return F.transform(F.filter(located, lambda f: _valid(kind.name, f.hit)), span).cast(SPAN)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``spans`` (all), each sorted by start, then kind as listed."""
    body = text_or_empty(text)
    kinds = (*BASE, *ADDED)
    out = docs.withColumns({f"_at_{k.name}": _located(body, k) for k in kinds})
    out = out.withColumns({f"_of_{k.name}": _spans(body, k, i, F.col(f"_at_{k.name}")) for i, k in enumerate(kinds)})
    out = out.withColumn("base_spans", F.array_sort(F.concat(*(F.col(f"_of_{k.name}") for k in BASE))))
    more = F.filter(
        F.concat(*(F.col(f"_of_{k.name}") for k in ADDED)),
        lambda s: (s.score >= ACCEPT) & ~F.exists("base_spans", lambda b: (b.start < s.end) & (s.start < b.end)),
    )
    out = out.withColumn("spans", F.array_sort(F.concat("base_spans", more)))
    return out.drop(*(f"_at_{k.name}" for k in kinds), *(f"_of_{k.name}" for k in kinds))


def is_kind(name: str):
    return lambda s: s.kind == name


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span, or chain of overlapping spans, replaced by its first kind in brackets."""
    found = find(docs, text)
    body = text_or_empty(text)
    state = "struct<at:int,parts:array<string>>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc.at + 1, s.start - acc.at)
        mask = F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))
        parts = F.when(s.start >= acc.at, F.concat(acc.parts, F.array(gap, mask))).otherwise(acc.parts)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), parts.alias("parts")).cast(state)

    clean = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")).cast(state),
        step,
        lambda acc: F.concat(F.array_join(acc.parts, ""), F.substring(body, acc.at + 1, F.length(body))),
    )
    return found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text))).drop("base_spans", "spans")
