"""Main text of web pages by template deduction.

A page is read as tokens: the opening of an element, named by its path of
structural elements with their classes, and every text block under its path. The
occurrence vector of a token says on which pages of its host it stands, and how
often; it is carried as a folded sum of page hashes, so it adds up over tasks and
no group of pages is ever collected. Tokens of one host with one vector form an
equivalence class; classes that stand on nearly all pages (``SHARE`` of at least
``LEAST_PAGES`` pages of different content) are the template, nested by their
paths. Text blocks in the template are not page content. What lies between the
template's elements are slots: a slot is judged by what its element is for
(menus, forms, notices and the like are left out) and, where a page marks no
article, by the share of linked text the slot has over all pages of the host.

Nulls: null html is an empty page with empty text; a null url is a host of its
own. Rows that repeat come back each, and count once for the template. Markup cut
off at the end ends the page; unclosed elements end with their parents. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgrid.llm.common import slices, spread, staged

LEAST_PAGES = 5
SHARE = 0.9
LINKED = 0.5
# Template tokens, of about a hundred bytes each, that may go to every executor.
BROADCAST_TOKENS = 100_000
SALTS = 64

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none""", re.IGNORECASE)
# Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
# Elements that end a block; all others are part of a line.
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section"
    " select summary table tbody td tfoot th thead tr ul title script style textarea iframe noscript template".split()
)
# Elements that make up a path; the rest may be left unclosed without harm.
STRUCTURE = set(
    "html head body main article section div nav header footer aside form ul ol dl table figure fieldset dialog menu"
    " search noscript template svg button select object canvas video audio".split()
)
NEVER = set(
    "head nav footer aside form menu search noscript template svg button select object canvas video audio dialog".split()
)
# Words in a class, id or role that say what an element is for.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside"
    " complementary cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup"
    " login comment comments disqus reply replies respond share sharing social related recommended trending breadcrumb"
    " breadcrumbs menu nav navbar navigation pagination pager footer contentinfo copyright masthead widget toolbar search"
    " alert skip paywall".split()
)
OUTSIDE_WORDS = {"header", "top", "topbar"}
COMMENT_WORDS = {"comment", "comments", "disqus", "reply", "replies", "respond"}


def words_in(attributes: str) -> tuple[str, set[str]]:
    """A short name from the class or id, and the words of class, id and role."""
    name, words = "", set()
    for kind, *values in NAMED.findall(attributes):
        value = next((v for v in values if v), "").lower()
        words.update(w for w in re.split(r"[^a-z]+", value) if w)
        if not name and kind.lower() != "role":
            name = re.sub(r"\d+", "", value.split(" ")[0])[:40]
    return name, words


class Block:
    """Text of one block: where it stands, whether an article holds it, and how much of it is linked."""

    __slots__ = ("path", "text", "linked", "article")

    def __init__(self, path: str, text: str, linked: int, article: bool):
        self.path, self.text, self.linked, self.article = path, text, linked, article


def read_page(page: str) -> tuple[dict[str, int], list[Block]]:
    """How often each path opens, and the blocks of the page outside elements that never hold content."""
    opened: dict[str, int] = defaultdict(int)
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # element, path, left out, in an article
    parts: list[str] = []
    linked, link, at = 0, 0, 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                path, article = (stack[-1][1], stack[-1][3]) if stack else ("", False)
                blocks.append(Block(path, text, min(linked, len(text)), article))
        linked = 0

    def text(until: int) -> None:
        nonlocal linked
        if until > at and not (stack and stack[-1][2]):
            parts.append(page[at:until])
            if link:
                linked += until - at

    while True:
        tag = TAG.search(page, at)
        if tag is None:
            text(len(page))
            break
        text(tag.start())
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name in BLOCKS or name in STRUCTURE:
            close_block()
        if name == "a":
            link = 0 if closing else 1
        if closing:
            if name in STRUCTURE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in STRUCTURE or attributes.endswith("/"):
            continue
        if name == "body":  # the head may be unclosed
            stack = [s for s in stack if s[0] == "html"]
        above = stack[-1] if stack else ("", "", False, False)
        label, words = words_in(attributes) if attributes else ("", set())
        path = f"{above[1]}/{name}.{label}" if label else f"{above[1]}/{name}"
        opened[path] += 1
        main = name in ("article", "main")
        if main and not words & COMMENT_WORDS:
            # An unclosed menu or advert does not swallow the article behind it.
            out = any(s[2] and (s[0] in ("aside", "template", "noscript") or "comment" in s[1]) for s in stack)
        else:
            out = above[2] or name in NEVER or bool(words & ASIDE_WORDS) or bool(HIDDEN.search(attributes))
            out = out or (not above[3] and (name == "header" or bool(words & OUTSIDE_WORDS)))
        stack.append((name, path, out, above[3] or main))
    close_block()
    return opened, blocks


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", url or "", re.IGNORECASE)
    return found[1].lower() if found else ""


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text) >> 1
    return value or 1


TEXTS = "key long, url string, text string, n_chars long"
TOKENS = "host string, path string, block long, page long, times long, chars long, linked long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each page: paths (block 0) with the text right under them, and text blocks by hash."""
    names = [c.split()[0] for c in TOKENS.split(", ")]
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                host, page_hash = host_of(url), _hash(page or "")
                opened, blocks = read_page(page or "")
                rows.append((host, "", 0, page_hash, 1, 0, 0))
                size: dict[str, list[int]] = defaultdict(lambda: [0, 0])
                times: dict[tuple[str, int], int] = defaultdict(int)
                for b in blocks:
                    size[b.path][0] += len(b.text)
                    size[b.path][1] += b.linked
                    times[b.path, _hash(b.text)] += 1
                rows.extend((host, p, 0, page_hash, n, *size[p]) for p, n in opened.items() if p)
                rows.extend((host, p, h, page_hash, n, 0, 0) for (p, h), n in times.items())
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)


def templates(pages: DataFrame) -> DataFrame:
    """Per host the tokens of its template: ``host, tokens`` with path, block hash, class and linked share.

    A host's list is bounded by what stands on nearly every one of its pages.
    """
    tokens = pages.select("url", "html").mapInArrow(_tokens, TOKENS)
    # Pages of equal content count once; the page hash stands for the content.
    distinct = tokens.groupBy("host", "path", "block", "page").agg(
        F.max("times").alias("times"), F.max("chars").alias("chars"), F.max("linked").alias("linked")
    )
    occurs = distinct.groupBy("host", "path", "block").agg(
        F.count(F.lit(1)).alias("pages"),
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
    )
    total = occurs.where("path = '' AND block = 0").select("host", F.col("pages").alias("of"))
    often = occurs.where(F.col("pages") >= LEAST_PAGES).join(total, "host")
    often = often.where((F.col("pages") >= SHARE * F.col("of")) & (F.col("path") != ""))
    share = F.when(F.col("chars") > 0, F.col("linked") / F.col("chars")).otherwise(F.lit(0.0))
    token = F.struct("path", "block", share.alias("linked"))
    # A class is valid if an element belongs to it: text hangs on the elements it comes and goes with.
    classes = often.groupBy("host", "vector").agg(F.collect_list(token).alias("tokens"), F.min("block").alias("least"))
    valid = classes.where(F.col("least") == 0).select("host", "tokens")
    # Sorted by path, every element stands before what is nested in it.
    return valid.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("tokens"))


def main_text(page: str | None, tokens: list[dict] | None) -> str:
    """The blocks outside the template, of the article if the page marks one, else of slots that are not mostly links."""
    _, blocks = read_page(page or "")
    fixed = {(t["path"], t["block"]) for t in tokens or () if t["block"]}
    linked = {t["path"]: t["linked"] for t in tokens or () if not t["block"]}
    kept = [b for b in blocks if (b.path, _hash(b.text)) not in fixed]
    if any(b.article for b in blocks):
        return " ".join(b.text for b in kept if b.article)

    def slot_links(block: Block) -> float:
        """Linked share of the innermost template element around a block, over the host; its own elsewhere."""
        path = block.path
        while path:
            if path in linked:
                return linked[path]
            path = path.rpartition("/")[0]
        return block.linked / len(block.text)

    return " ".join(b.text for b in kept if slot_links(b) <= LINKED and block_links(b) <= LINKED)


def block_links(block: Block) -> float:
    return block.linked / max(1, len(block.text))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            pairs = zip(part.column("html").to_pylist(), part.column("tokens").to_pylist(), strict=True)
            texts = [main_text(page, tokens) for page, tokens in pairs]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [part.column("key"), part.column("url"), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["key", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: ``key, url, text, n_chars``."""
    rows = spread(pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(page).alias("html")))
    named = rows.withColumn(
        "host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?i:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1))
    )
    found = staged(templates(rows), "templates")
    held = found.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    if held <= BROADCAST_TOKENS:
        joined = named.join(F.broadcast(found), "host", "left")
    else:
        # A host of many pages is a hot key: its pages are spread, its template copied.
        salted = named.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, ["host", "salt"], "left")
    texts = joined.select("key", "url", "html", "tokens").mapInArrow(_extracted, TEXTS)
    return texts.withColumnsRenamed({"key": key, "url": url})
