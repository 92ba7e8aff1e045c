"""Main text of HTML pages by a site style tree.

The DOMs of all pages of a host are merged: a style node is a path of tags with their classes.  A content node is
weighed by the entropy of its blocks of text over the host's m different pages: a block on c of them has the entropy
log c / log m, and the node's importance is one minus the mean.  A presentation node is weighed by the entropy of the
styles of its children over the pages, mixed with its children's importance.  Nodes of low importance are boilerplate,
with all below them, on hosts of two pages as on those of millions; a heading goes only with the node that it stands in.
A node that one page alone has keeps its importance of 1.  Where high nodes hold less than LEAST_SHARE of what a page
has, its neighbours are copies of it rather than of one template, and none is removed from it.

Entropy can't tell chrome whose words change from page to page (a menu of random links) from an article.  So a node's
importance is also multiplied by the share of its blocks that are not wholly links, outside of the marked main part; and
elements that HTML itself defines as menu, header, footer, sidebar, advert, form or comments, and containers whose class
names say the same, have importance 0 whatever their entropy.  Elements marked as the article are one region for each
style path; the region with most text is the page's, unless the text outside of all is more than MARK_WEIGHT times that.  What
a class name alone marks is such a region only beside elements that HTML itself so defines.
A form around the marked main part, or around all that a page has, is none of the page's forms.

Rows: null or empty HTML gives an empty text; a null URL has the host ''; unclosed elements and cut-off pages are read
as far as they go; every row yields one row, repeated pages count once for their host; other columns are ignored; an empty
table yields an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settled
from .url_filter import host_of

# Element names of the HTML standard, by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe object svg select".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split())
CHROME = frozenset("nav header footer aside form button menu dialog head search fieldset".split())
ARTICLE = frozenset(("article", "main"))
#: An open element of the first kind is closed by a tag of the second.
CLOSED_BY = {"p": BLOCK - {"br"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
# Words of class names and ids that mark what is not the article, as the whole name or its last part.
CHROME_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header login masthead menu modal nav navbar navigation newsletter notice notification popup promo promoted recommended related respond share sharing sidebar signup social sponsor sponsored subscribe teaser teasers toolbar widget widgets".split())
#: Such a word may also come first, before one of these, which only name a part of the page.
PART_WORDS = frozenset("area bar block body box buttons container content form group inner items links list panel posts section slot thread unit wrap wrapper zone".split())
#: Only containers are judged by their names; a paragraph or heading is judged by the tree.
CONTAINERS = frozenset("details div dl ol section table ul".split())
#: A name that begins so tells what an element has or lacks, not what it is.
STATES = frozenset("anti has hide is no non not with without".split())
#: Elements that hold the article, whatever their names say; names of other elements that do.
HOLDERS = frozenset("html body main article".split())
MAIN_WORDS = frozenset("main content article".split())
#: A header with such a name is that of the article.
ARTICLE_PARTS = frozenset("entry post article story content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# a quote only counts after an equals sign; one that isn't closed counts as a letter
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)""")
NAMING = frozenset("class id role".split())
SPACE = re.compile(r"\s+")
DIGITS = re.compile("[0-9]+")
END_OF = {tag: re.compile(rf"<(/?){tag}\b[^>]*>", re.IGNORECASE) for tag in RAW}
#: What a block lies under: nothing of the kind, a form, an article that its name calls something else, chrome.
CLEAR, IN_FORM, BY_NAME, CHROME_ABOVE = range(4)


class Node(NamedTuple):
    """An open element: its style path, what it lies under, and the path of the outermost element marked as main part."""

    tag: str
    path: str
    under: int
    region: str


class Block(NamedTuple):
    """A block of text; link: all of its text is that of links."""

    path: str
    under: int
    region: str
    link: bool
    text: str


def raw_end(page: str, tag: str, at: int, closed: bool) -> int:
    """Where the content of a raw element that begins at a place ends; closed: its tag ends in />.

    Such a tag has no content if none of its kind ends before the next begins.
    """
    for found in END_OF[tag].finditer(page, at):
        if found[1]:
            return found.end()
        if closed:
            return at
    return at if closed else len(page)


def names_of(attributes: str) -> set[str]:
    """The words of class, id and role, in lower case."""
    return {w.lower() for m in ATTRIBUTE.findall(attributes) if m[0].lower() in NAMING for w in (m[1] or m[2] or m[3]).split()}


def blocks(page: str) -> Iterator[Block]:
    """Each block of text in page order."""
    stack = [Node("", "", CLEAR, "")]
    parts: list[str] = []
    plain = False  # whether text outside of links was seen in the block
    at, n = 0, len(page)

    def flush() -> Iterator[Block]:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                yield Block(block.path, block.under, block.region, not plain, text)

    def add(low: int, high: int) -> None:
        nonlocal plain
        parts.append(page[low:high])
        if not plain and not in_link and not parts[-1].isspace():
            plain = True

    block, in_link = stack[0], False
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            add(at, n)
            break
        if found.start() > at:
            add(at, found.start())
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not found[1] and not found[3].endswith("/")
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if tag in BLOCK:
                yield from flush()
                plain = False
            if depth:
                del stack[depth:]
                if tag in BLOCK:
                    block = _block(stack)
            continue
        closed = found[3].endswith("/")
        if tag in BLOCK:
            yield from flush()
            plain = False
            while len(stack) > 1:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in CLOSED_BY or stack[k].tag in BLOCK), 0)
                if not depth or tag not in CLOSED_BY.get(stack[depth].tag, ()):
                    break
                del stack[depth:]
        if tag in RAW:
            at = at if tag == "svg" and closed else raw_end(page, tag, at, closed)
            continue
        if tag in VOID or closed:
            block = _block(stack)
            continue
        _, path, under, region = stack[-1]
        names = names_of(found[3]) if "=" in found[3] else set()
        path = f"{path}>{tag}" + "".join(f".{DIGITS.sub('0', w)}" for w in sorted(names))
        main = tag in ARTICLE or any(is_main(w) for w in names)
        if under == IN_FORM and main and not region:
            under = CLEAR
        elif under < CHROME_ABOVE:
            # the heading of an article may stand in a header of its own
            if (tag in CHROME and tag != "form" and not (tag == "header" and region)) or (tag in CONTAINERS and not main and any(is_chrome(w, bool(region)) for w in names)):
                under = CHROME_ABOVE
            elif tag == "article" and names & CHROME_WORDS:
                under = CHROME_ABOVE if region else max(under, BY_NAME)
            elif tag == "form":
                under = CHROME_ABOVE if region else max(under, IN_FORM)
        stack.append(Node(tag, path, under, region or (path if main and under < BY_NAME else "")))
        if tag in BLOCK:
            block = stack[-1]
    yield from flush()


def is_chrome(name: str, in_article: bool) -> bool:
    """Whether a class, id or role says that a container is no part of the article."""
    words = re.findall("[a-z]+", name)
    if not words or words[0] in STATES:
        return False
    if words[-1] in CHROME_WORDS:
        return words[-1] != "header" or not (in_article or words[0] in ARTICLE_PARTS)
    return words[0] in CHROME_WORDS and words[-1] in PART_WORDS and words[0] != "header"


def is_main(name: str) -> bool:
    """Whether a class, id or role says that an element is the article: content, entry-content, article-body."""
    first, _, last = name.partition("-")
    return name in MAIN_WORDS or (first in ARTICLE_PARTS and last in ("body", "content", "text"))


def _block(stack: list[Node]) -> Node:
    return next((x for x in reversed(stack) if x.tag in BLOCK), stack[0])


def tag_of(path: str) -> str:
    return path.rpartition(">")[2].partition(".")[0]


#: A character in the marked main part counts as so many elsewhere, when the page's text is chosen.
MARK_WEIGHT = 4
#: The tree leaves at least so much of a page's text, or else all.
LEAST_SHARE = 0.25


def main_text(page: str, low: frozenset[str] = frozenset(), links: frozenset[str] = frozenset()) -> str:
    """The page's main text.

    low: style nodes of low importance; links: those of low importance outside of a marked main part.
    """
    found = [b for b in blocks(page) if b.under < CHROME_ABOVE]
    for most in (CLEAR, IN_FORM, BY_NAME):
        kept = [b for b in found if b.under <= most]
        if kept:
            break
    below: dict[tuple[str, bool], bool] = {("", False): False, ("", True): False}

    def is_low(path: str, outside: bool) -> bool:
        if (path, outside) not in below:
            above = path.rpartition(">")[0]
            own = tag_of(path) not in HEADINGS and (path in low or (outside and path in links))
            below[path, outside] = own or is_low(above, outside)
        return below[path, outside]

    def chosen(kept: list[Block]) -> list[Block]:
        sizes: dict[str, int] = {}
        for b in kept:
            sizes[b.region] = sizes.get(b.region, 0) + len(b.text)
        outside = sizes.pop("", 0)
        if not any(tag_of(region) in ARTICLE for region in sizes):
            return kept  # a name alone hides nothing
        best = max(sizes, key=sizes.__getitem__, default="")
        region = best if best and sizes[best] * MARK_WEIGHT >= outside else ""
        return [b for b in kept if b.region == region]

    if low or links:
        high = [b for b in kept if not is_low(b.path, not b.region)]
        before, after = chosen(kept), chosen(high)
        if after and sum(len(b.text) for b in after) >= LEAST_SHARE * sum(len(b.text) for b in before if b.region or b.path not in links):
            return "\n".join(b.text for b in after)
    return "\n".join(b.text for b in chosen(kept))


def style_features(pages: DataFrame) -> DataFrame:
    """host, path, content, feature, page and link: the texts of content nodes and the children's styles of presentation nodes.

    page is a signature of the page's text, so that copies of a page count as one.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(blocks(page))
                signature = hash64("\n".join(b.text for b in found if b.under < CHROME_ABOVE))
                children: dict[str, list[str]] = {}
                for path, _, _, link, text in found:
                    rows.append((host, path, True, hash64(text), signature, link))
                    while path:
                        above = path.rpartition(">")[0]
                        children.setdefault(above, []).append(path)
                        path = above
                rows += [(host, path, False, hash64("|".join(below)), signature, False) for path, below in children.items() if path]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()))], ["host", "path", "content", "feature", "page", "link"])

        return work

    return map_arrow(pages.select("host", "html"), make, "host string, path string, content boolean, feature long, page long, link boolean")


def hash64(text: str) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(text)).astype(np.int64))


#: Weight of the importance of a presentation node's children, to the power of their number.
CHILDREN_WEIGHT = 0.9


def importance(nodes: pd.DataFrame, by_links: bool = False) -> dict[str, float]:
    """Importance of the style nodes of one host, from path, content, m, mean_log, sum_log (of c log c) and links.

    by_links: content counts by the share of its blocks that are not links.
    """
    own: dict[tuple[str, bool], float] = {}
    for path, content, m, mean_log, sum_log, links in zip(*(nodes[c] for c in ("path", "content", "m", "mean_log", "sum_log", "links")), strict=True):
        x = 1.0 if m < 2 else float(1 - mean_log / np.log(m)) if content else float(np.clip(1 - sum_log / (m * np.log(m)), 0, 1))
        own[path, content] = x * (1 - links) if content and by_links else x
    children: dict[str, list[str]] = {}
    paths = {p for p, _ in own}
    for p in paths:
        children.setdefault(p.rpartition(">")[0], []).append(p)
    out: dict[str, float] = {}
    for p in sorted(paths, key=lambda p: -p.count(">")):  # children first
        parts = [out[c] for c in children.get(p, ())]
        if parts:
            weight = CHILDREN_WEIGHT ** len(parts)
            best = max(parts)
            # what has nothing of importance in it has none, however its parts are styled
            inner = (1 - weight) * own.get((p, False), 0.0) + weight * best if best > 0 else 0.0
            out[p] = max(inner, own.get((p, True), 0.0))
        else:
            out[p] = own.get((p, True), own.get((p, False), 1.0))
    return out


def low_importance(pages: DataFrame, threshold: float = 0.2) -> DataFrame:
    """host and its style nodes whose importance is under the threshold: low, and links, which are so by their links alone.

    What a host's task gets is a row for each style node, however many pages the host has.
    """
    features = settled(style_features(pages).distinct(), "style-features")  # read twice, parsed once
    counted = features.groupBy("host", "path", "content", "feature").agg(F.countDistinct("page").alias("c"), F.avg(F.col("link").cast("int")).alias("link"))
    logs = counted.groupBy("host", "path", "content").agg(F.avg(F.log("c")).alias("mean_log"), F.sum(F.col("c") * F.log("c")).alias("sum_log"), F.avg("link").alias("links"))
    shared = features.select("host", "path", "content", "page").distinct().groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("m"))

    def low(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        found = {p for p, x in importance(nodes).items() if x < threshold}
        links = {p for p, x in importance(nodes, True).items() if x < threshold} - found
        return pd.DataFrame({"host": [key[0]], "low": [sorted(found)], "links": [sorted(links)]})

    return logs.join(shared, ["host", "path", "content"]).groupBy("host").applyInPandas(low, "host string, low array<string>, links array<string>").filter("size(low) + size(links) > 0")


def extract_text(pages: DataFrame, threshold: float = 0.2) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.coalesce("url", F.lit(""))).alias("host"))
    # written first, so that its size is known when the join is planned: broadcast if small, else by a shuffle
    low = settled(low_importance(rows, threshold), "style-nodes")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(page, frozenset(low or ()), frozenset(links or ())) for page, low, links in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return work

    return map_arrow(rows.join(low, "host", "left").select("page_id", "url", "html", "low", "links"), make, "page_id long, url string, text string, n_chars long")
