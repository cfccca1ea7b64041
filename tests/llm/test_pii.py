import re
from collections import Counter

from pyspark.sql import functions as F

from moodgrid.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "mail a@b.c, x.y+z@ex-am.co.uk. a@b@c.de @x.y a@b",
    "ip 10.0.0.1 and 256.1.1.1, 1.2.3.4.5.6.7.8.9 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 4111111111111111 2",
    "call +49 (30) 123-4567 or +1 2 or +1.800.555.0199-",
    "日本 😀 a@b.cd 😀 +33 1 23 45 67 89",
    "4242 4242 4242 4242 10.1.1.1 +4242 4242 4242 4242",
    "",
    None,
    "no data here",
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    found = [
        (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]
    return ",".join(s for *_, s in sorted(found))


def test_base_spans_are_those_of_the_plain_patterns(spark, small):
    texts = TEXTS + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(docs).select("doc_id", pii.listed(F.col("base_spans")).alias("s"), pii.listed(F.col("spans")).alias("a"))
    for r in found.collect():
        assert r["s"] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert set(filter(None, r["s"].split(","))) <= set(r["a"].split(","))


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE88 3704 0044 0532 0130 00.", "my ssn 078-05-1120", "part 078-05-1120"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(docs).collect()}
    assert "iban" in kinds[0] and "iban" not in kinds[1]
    assert kinds[2] == ["ssn"] and kinds[3] == []


def test_redacted_texts(spark):
    docs = spark.createDataFrame([(1, "to 😀 a@b.cd or 10.0.0.1!", 7), (2, None, 8), (3, "clean", 9)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "to 😀 [EMAIL] or [IP]!", 2: None, 3: "clean"}


def test_odd_rows_and_empty_table(odd):
    rows = pii.find(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert all(r["spans"] == [] for r in rows)
    assert pii.find(odd.limit(0)).count() == 0
