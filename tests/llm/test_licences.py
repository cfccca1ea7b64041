import regex

from moodgrid.llm import licences


def grams(text):
    words = regex.sub(licences.OTHER, " ", text.lower()).strip().split(" ")
    return set(zip(words, words[1:], strict=False))


def test_scan_agrees_with_brute_force(spark, small):
    templates = [(name, grams(text)) for name, text in licences.TEMPLATES]
    some = licences.TEMPLATES[0][1]
    texts = [some, some.upper() + "!", f"first\n{some}\n\nlast words", "", None, "no licence", some + " and rather many more words follow it here"]
    texts += [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    want = set()
    for key, text in enumerate(texts):
        if text is None:
            continue
        units = [("line", i, u) for i, u in enumerate(text.split("\n"))]
        paragraphs = regex.split(licences.PARAGRAPH, text)
        units += [("paragraph", i, u) for i, u in enumerate(paragraphs)] if len(paragraphs) > 1 else []
        units += [("text", 0, text)] if "\n" in text else []
        for unit, place, body in units:
            own = grams(body)
            scores = [(-2 * len(own & t) / (len(own) + len(t)), name) for name, t in templates]
            score, name = min(scores)
            if -score >= licences.THRESHOLD:
                want.add((key, unit, place, name, round(-score, 6)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in licences.scan(docs).collect()} == want
    assert any(w[:3] == (2, "line", 1) for w in want)


def test_odd_rows_and_empty_table(odd):
    assert licences.scan(odd).count() == 0
    assert licences.scan(odd.limit(0)).count() == 0
