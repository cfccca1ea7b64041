import html
import re

from moodgrid.llm import extraction

PAGES = "page_id long, url string, html string, text string, host string"


def article_text(page):
    found = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)
    body = re.sub(r"<[^>]*$", "", found[1]) if found else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {r["page_id"]: article_text(r["html"] or "") for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extract(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_template_is_taken_off_pages_without_an_article(spark, monkeypatch):
    page = "<html><body><div class=x><p>Welcome to the site</p></div><div class=y><p>Story number {0} &amp; more</p></div></body></html>"
    rows = [(i, f"http://a.org/{i}", page.format(i), None, None) for i in range(12)]
    rows += [(99, "http://b.org/", page.format(99), None, None)]
    want = {i: f"Story number {i} & more" for i in range(12)} | {99: "Welcome to the site Story number 99 & more"}
    pages = spark.createDataFrame(rows, PAGES)
    for bound in (extraction.BROADCAST_TOKENS, 0):  # the broadcast, then the salted join
        monkeypatch.setattr(extraction, "BROADCAST_TOKENS", bound)
        assert {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()} == want


def test_what_is_left_out(spark):
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><nav><a href=#>menu</a></nav><header>top</header>"
        "<article><h1>Title</h1><p>One<b>two</b> &lt;x&gt;\n  three</p><script>var a='<p>no</p>'</script>"
        "<div class='ad-slot'>buy</div><form>mail</form><!-- no --><p>four</p><section class=comments>hi</section></article>"
        "<aside>side</aside><footer>end</footer></body></html>"
    )
    got = extraction.extract(spark.createDataFrame([(1, None, page, "t", "h")], PAGES)).collect()
    assert [r["text"] for r in got] == ["Title Onetwo <x> three four"]


def test_odd_pages_and_empty_table(spark):
    long_page = "<article><p>" + "word " * 60_000 + "</p></article>"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "http://a", "", None, None), (2, "http://a", "<p>cut <", None, None), (3, "x", long_page, None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in extraction.extract(pages).collect()), key=repr)
    assert [g[0] for g in got].count(1) == 2 and len(got) == 5
    assert {(k, t) for k, t, _ in got if k in (1, None)} == {(1, ""), (None, "")}
    assert next(n for k, _, n in got if k == 3) == len("word " * 60_000) - 1
    assert extraction.extract(pages.limit(0)).count() == 0
