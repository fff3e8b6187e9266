"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text.  For every root-to-leaf tag path the
lengths of its blocks' text outside links and their punctuation marks are summed
and divided by the number of its blocks; the two ratios are fused, smoothed over
the blocks in page order, and blocks over a share of the standard deviation are
content.  The container is the deepest element that holds most of the content.
In an element that says it is the article everything is kept that isn't furniture;
elsewhere, blocks whose path is content, and their headings, lists and short
paragraphs beside them.  Furniture is known by its element's name (navigation,
footers, forms, ...) or by its class, id or role, where a name counts only if it
says nothing else ("share-buttons" does, "social-history" doesn't).

Character references are decoded, white space inside a block becomes one space
(a line break is white space), blocks are joined in page order by a line feed.
Null and empty html have no text, and neither has a page of furniture alone.
Unclosed elements, comments and tags are closed by the page's end.  Each page is
worked on alone, in time that is linear in its length: rows are never moved, and
repeated rows and ids get a row each.  Extra columns pass through; a column of
the name of an added one is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the standard deviation over which a smoothed ratio is content; share of the content a container holds.
LIMIT, HOLDS = 0.5, 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td"
    " tfoot th thead title tr ul noscript script style template textarea iframe object video audio canvas svg button".split()
)
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements that never hold main text.
FURNITURE = frozenset(
    "head title script style noscript template iframe object nav footer aside form button select option textarea input fieldset legend"
    " svg canvas video audio dialog menu noframes noembed".split()
)
#: Words of class, id and role that say the same; a name such as "share-buttons" says so if all its words are signs or helpers.
SIGNS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr"
    " notice notices notification notifications alert alerts popup modal overlay sidebar aside complementary menu menus nav navbar navigation"
    " breadcrumb breadcrumbs footer contentinfo masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion"
    " share sharing social related recommended recommendations newsletter subscribe subscription signup login search form widget widgets"
    " pagination pager copyright legal disclaimer skip".split()
)
HELPERS = frozenset(
    "area articles bar block bottom box btn button buttons center column content container cta footer frame global group head header holder icon"
    " icons inline inner item items js left link links list main message middle module more outer page panel post posts primary read right row"
    " secondary section site slot small stories sticky strip text thread title to top unit up user video wrap wrapper you your like may also"
    " site policy us follow in on the and for no of".split()
)
HEADER_SIGNS = frozenset(("header", "banner"))
ARTICLE_SIGNS = frozenset("article main content post entry story articlebody maincontent".split())
CONTAINERS = frozenset("html body article main section div td table tbody tr center".split())
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dd dt figcaption td th".split())
#: Elements that an opening tag closes.
CLOSES = {
    "li": ("li", frozenset(("ul", "ol", "menu"))), "dd": ("dd dt", frozenset(("dl",))), "dt": ("dd dt", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))),
    "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",))),
}
ENDS_P = BLOCK - frozenset("script style template noscript option optgroup title textarea iframe object video audio canvas svg button".split())

TAG = re.compile(r"""<(?:!--(?P<note>.*?)(?:-->|--!>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
NAME = re.compile(r"[^\s]+")
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[a-z]+")
MARKS = re.compile(r"""[.,;:!?…。，、；：！？"“”«»¿¡]""")


def _furniture(words: list[str], in_article: bool) -> bool:
    """Whether a class, id or role names furniture; headers of an article are its own."""
    signs = [w for w in words if w in SIGNS or (not in_article and w in HEADER_SIGNS)]
    return bool(signs) and all(w in SIGNS or w in HELPERS or w in HEADER_SIGNS or len(w) < 3 for w in words)


class _Page:
    """Elements and blocks of one page."""

    __slots__ = ("tags", "parents", "bad", "article", "paths", "blocks")

    def __init__(self) -> None:
        self.tags, self.parents, self.bad, self.article = ["#"], [-1], [False], [False]
        self.paths: list[int] = [0]
        #: (text, element, characters in links)
        self.blocks: list[tuple[str, int, int]] = []


def _read(html: str) -> _Page:
    page = _Page()
    tags, parents, bad, article, paths, blocks = page.tags, page.parents, page.bad, page.article, page.paths, page.blocks
    known: dict[tuple[int, str], int] = {}
    stack, parts = [0], []
    #: Places in the stack, innermost last: of each element name and of all block elements.
    open_, blocks_open = {"#": [0]}, [0]
    linked, links_open, pos = 0, 0, 0
    home = 0  # the block element or inline element where the open block's text began
    n = len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((text, home, linked))
            parts.clear()
            linked = 0

    def add(raw: str) -> None:
        nonlocal linked, home
        text = unescape(raw) if "&" in raw else raw
        if not bad[stack[-1]]:
            if not parts:
                home = stack[-1]
            parts.append(text)
            if links_open:
                linked += len(text.strip())

    def pop(to: int) -> None:
        nonlocal links_open
        while len(stack) > to:
            tag = tags[stack.pop()]
            open_[tag].pop()
            links_open -= tag == "a"
        while blocks_open[-1] >= to:
            blocks_open.pop()

    def innermost(name: str) -> int:
        places = open_.get(name)
        return places[-1] if places else -1

    while pos < n:
        m = TAG.search(html, pos)
        if m is None:
            add(html[pos:])
            break
        if m.start() > pos:
            add(html[pos : m.start()])
        pos = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            flush()
        if m["close"]:
            at = innermost(name)
            if at > 0 and (name in BLOCK or at > blocks_open[-1]):  # an inline end never closes a block
                pop(at)
            continue
        if name in VOID:
            continue
        if name in ENDS_P:
            if tags[stack[blocks_open[-1]]] == "p":
                pop(blocks_open[-1])
        if name in CLOSES:
            closed, until = CLOSES[name]
            at = max(innermost(x) for x in closed.split())
            if at > max(innermost(x) for x in until):
                pop(at)
        up = stack[-1]
        attrs = m["attrs"]
        is_bad, is_article = bad[up] or name in FURNITURE, article[up] or name in ("article", "main")
        if name == "header" and not article[up]:
            is_bad = True
        if attrs and not is_bad:
            found = [WORD.findall(x) for t in ATTR.findall(attrs) for x in NAME.findall(" ".join(t).lower())]
            if found:
                says_article = name in CONTAINERS and any(len(x) == 1 and x[0] in ARTICLE_SIGNS for x in found)
                is_article = is_article or says_article or (name in CONTAINERS and any(not ARTICLE_SIGNS.isdisjoint(x) and SIGNS.isdisjoint(x) for x in found))
                is_bad = name not in ("html", "body") and not says_article and any(_furniture(x, article[up]) for x in found)
            is_bad = is_bad or HIDDEN.search(attrs) is not None
        tags.append(name)
        parents.append(up)
        bad.append(is_bad)
        article.append(is_article)
        paths.append(known.setdefault((paths[up], name), len(known) + 1))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, pos)
            pos = n if end is None else end.start()
            if end is not None:
                close = html.find(">", pos)
                pos = n if close < 0 else close + 1
            tags.pop(), parents.pop(), bad.pop(), article.pop(), paths.pop()
            continue
        if not attrs.rstrip().endswith("/") or name not in ("svg", "path"):
            stack.append(len(tags) - 1)
            open_.setdefault(name, []).append(len(stack) - 1)
            if name in BLOCK:
                blocks_open.append(len(stack) - 1)
            links_open += name == "a"
    flush()
    return page


def ratios(page: _Page) -> dict[int, float]:
    """Of each tag path, length of text outside links a block, fused with marks a block."""
    sums: dict[int, list[float]] = {}
    for text, at, linked in page.blocks:
        s = sums.setdefault(page.paths[at], [0.0, 0.0, 0.0])
        s[0] += max(0, len(text) - linked)
        s[1] += len(MARKS.findall(text)) if linked * 2 < len(text) else 0
        s[2] += 1
    return {k: a / n * math.sqrt(1 + b / n) for k, (a, b, n) in sums.items()}


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = _read(html)
    blocks = page.blocks
    if not blocks:
        return ""
    fused = ratios(page)
    row = [fused[page.paths[at]] for _, at, _ in blocks]
    last = len(row) - 1
    smooth = [(row[max(0, i - 1)] + 2 * row[i] + row[min(last, i + 1)]) / 4 for i in range(len(row))]
    mean = sum(smooth) / len(smooth)
    limit = min(LIMIT * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), 0.5 * max(smooth))
    content = [x >= limit and r > 0 and r >= 0.5 * limit for x, r in zip(smooth, row, strict=True)]
    # the deepest element that holds most of it
    held = [0] * len(page.tags)
    for (text, at, linked), is_content in zip(blocks, content, strict=True):
        if is_content:
            held[at] += max(0, len(text) - linked)
    for e in range(len(held) - 1, 0, -1):  # an element comes after its parent
        held[page.parents[e]] += held[e]
    total = held[0]
    if not total:
        return ""
    top = max((e for e, size in enumerate(held) if size >= HOLDS * total and (page.tags[e] in CONTAINERS or e == 0)), default=0)
    outer = top
    while outer > 0 and page.article[page.parents[outer]]:
        outer = page.parents[outer]
    if page.article[top]:
        top = outer
    inside = [False] * len(held)
    inside[top] = True
    for e in range(top + 1, len(held)):
        inside[e] = inside[page.parents[e]]
    chosen = {page.paths[at] for (_, at, _), is_content in zip(blocks, content, strict=True) if is_content}
    parents = {page.parents[at] for (_, at, _), is_content in zip(blocks, content, strict=True) if is_content}
    out = []
    for text, at, linked in blocks:
        if not inside[at]:
            continue
        mostly_links = linked * 3 > len(text) * 2
        if page.article[top]:
            keep = not mostly_links or page.paths[at] in chosen or page.tags[at] not in ("a", "li")
        else:
            keep = page.paths[at] in chosen or (not mostly_links and page.tags[at] in BESIDE and page.parents[at] in parents)
        if keep:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Adds the pages' main text."""
    keep = pages.drop(out_col) if out_col != html_col else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = b.column(b.schema.get_field_index(html_col))
            text = pa.array([main_text(x.as_py()) for x in html], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, out_col])

    if out_col == html_col:
        raise ValueError("the text needs a column of its own")
    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField(out_col, T.StringType())]))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
