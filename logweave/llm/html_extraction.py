"""HTML extraction with site template removal.

A first pass hashes element subtrees; Spark counts, for each host, on how many different pages each occurs; a second
pass deletes those that many pages of the host share and takes the main text of what is left: of its articles, else of
its main element, else of its body, without what tags and class names mark as no article. The hashes found are broadcast
while they are few; beyond that each page gets those of its own subtrees by a join on host and hash.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .url_filters import host

#: A subtree is template if so many different pages of its host have it. Pages with the same article count as one.
MIN_PAGES = 5
#: Template hashes of all hosts up to which they are broadcast; beyond, pages are shuffled to their own.
BROADCAST_HASHES = 500_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul head".split())
CELLS = frozenset(("td", "th", "br"))
DROPPED = frozenset("head script style noscript template nav footer aside form iframe svg math button select textarea input label dialog menu object embed canvas audio video map title".split())
#: Parts of class, id and role names that mark what isn't the article. Fixed values.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation sidebar breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments respond replies disqus share sharing social related recommended footer header masthead toolbar pagination pager widget search skip complementary contentinfo".split())
STATES = frozenset("has with no not without is js".split())
#: Never template: text of an article may stand on many pages.
TEXT = frozenset("article main body html head p h1 h2 h3 h4 h5 h6 li blockquote pre table tbody thead tfoot tr td th b i em strong a span br".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"""[^>"']*""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")


class Node:
    __slots__ = ("kids", "marks", "names", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.names, self.marks = tag, [], (), frozenset()
        if "=" in attrs and (found := _NAMES.findall(attrs)):
            self.names = [n for f in found for n in html.unescape("".join(f)).split()]
            each = [{w.lower() for w in _WORD.findall(n)} for n in self.names]
            self.marks = frozenset(w for words in each if not words & STATES for w in words)  # "has-sidebar" marks no sidebar


class _Open:
    """The open elements, the page itself first, and where in them those of each tag stand: no step walks up the page."""

    def __init__(self, top: Node):
        self.stack, self.blocks, self.places = [top], [0], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Ends the element at the place and all inside it."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close_before(self, tag: str) -> None:
        """Ends what the start of a ``tag`` ends: an open paragraph before a block, an item before the next of its list."""
        if tag in BLOCK and tag != "html" and tag != "body" and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in CLOSES:
            fence = max((self.places[t][-1] for t in FENCE[tag] if self.places[t]), default=0)
            inside = [x[i] for t in CLOSES[tag] if (x := self.places[t]) and (i := bisect_right(x, fence)) < len(x)]
            if inside:
                self.close(min(inside))


def _tag_end(page: str, pos: int, quoted: list[bool]) -> int:
    """Where the tag's ``>`` stands, quoted ones aside. Once quotes run to the page's end they mean nothing any more."""
    at = pos
    while quoted[0]:
        at = _PLAIN.match(page, at).end()
        if at < len(page) and page[at] == ">":
            return at
        at = page.find(page[at], at + 1) + 1 if at < len(page) else 0
        quoted[0] = at > 0
    return page.find(">", pos)


def parse(page: str) -> Node:
    """The page's tree: kids are nodes and strings, tags in lower case; open elements end where HTML lets them.

    Takes time in proportion to the page, however malformed."""
    top = Node("")
    open_, quoted, unclosed = _Open(top), [True], set()
    pos, text, size = 0, 0, len(page)  # text: where the characters begin that aren't in the tree yet
    last = page.rfind(">")
    while pos < size:
        start = page.find("<", pos)
        if start < 0:
            break
        lead = page[start + 1 : start + 2]
        if lead in ("!", "?"):
            dashes = page.startswith("<!--", start)
            end = page.find("-->" if dashes else ">", start + (4 if dashes else 2))
            end = size if end < 0 else end + (3 if dashes else 1)
            name = None
        else:
            name = _NAME.match(page, start + (2 if lead == "/" else 1))
            end = _tag_end(page, name.end(), quoted) + 1 if name and last > start else 0
            if not end:  # no tag
                pos = start + 1
                continue
        if start > text:
            open_.stack[-1].kids.append(page[text:start])
        pos = text = end
        if not name:
            continue
        tag, attrs = name[0].lower(), page[name.end() : end - 1]
        if lead == "/":
            if places := open_.places[tag]:
                open_.close(places[-1])
            elif tag == "p":
                open_.stack[-1].kids.append(Node("p"))
            continue
        open_.close_before(tag)
        node = Node(tag, attrs)
        open_.stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = None if tag in unclosed else re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, pos)
            if close:
                if tag not in ("script", "style"):
                    node.kids.append(page[pos : close.start()])
                pos = text = close.end()
            elif tag in ("script", "style"):
                return top
            else:
                unclosed.add(tag)
            continue
        open_.push(node)
    if size > text:
        open_.stack[-1].kids.append(page[text:])
    return top


def hashes(top: Node) -> tuple[dict[Node, int], int]:
    """64-bit hash of each element's subtree (tag, names, text and what is in it); and of the whole page's text."""
    import xxhash

    found: dict[Node, int] = {}
    body = xxhash.xxh64()
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    for node in reversed(order):
        h = xxhash.xxh64(f"{node.tag}\0{' '.join(node.names)}\0")
        for k in node.kids:
            if isinstance(k, Node):
                h.update(found[k].to_bytes(8, "big"))
            elif t := " ".join(k.split()):
                h.update(t.encode("utf-8", "surrogatepass") + b"\1")
        found[node] = h.intdigest()
    for node in order:
        if node.tag == "article" or node.tag == "main":
            body.update(found[node].to_bytes(8, "big"))
            break
    else:
        body.update(found[top].to_bytes(8, "big"))
    del found[top]
    return found, body.intdigest()


def _unwanted(node: Node, inside: bool) -> bool:
    """inside: of the article."""
    if node.tag in ("article", "main", "body", "html"):
        return node.tag == "article" and bool({"comment", "reply"} & {n.lower() for n in node.names})
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    marks = node.marks & MARKS
    if inside:  # an article's own header has its title
        return bool(marks - {"header"}) and node.tag not in ("h1", "h2", "h3", "h4", "h5", "h6")
    return bool(marks)


def main_text(top: Node, template: frozenset[int] = frozenset()) -> str:
    """The page's main text: of its articles, else its main element, else its body, without what is no article or template."""
    cut = {n for n, h in hashes(top)[0].items() if h in template and n.tag not in TEXT} if template else set()

    def roots(tag: str) -> list[Node]:
        found, stack = [], [top]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                found.append(node)
                continue
            if node in cut or node is not top and _unwanted(node, False):
                continue
            stack += [k for k in reversed(node.kids) if isinstance(k, Node)]
        return [n for n in found if not _unwanted(n, False)]

    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(words).split()):
            blocks.append(text)
        words.clear()

    starts = roots("article") or roots("main") or [top]
    stack: list = [x for s in reversed(starts) for x in ((s, True), (s, False))]
    inside = starts != [top]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            words.append(html.unescape(node) if "&" in node else node)
            continue
        if node.tag in CELLS:
            words.append(" ")
        elif node.tag in BLOCK:
            flush()
        if leaving or node in cut or node is not top and _unwanted(node, inside):
            continue
        for k in reversed(node.kids):
            if isinstance(k, str):
                stack.append((k, False))
            else:
                stack += [(k, True), (k, False)]
    flush()
    return "\n".join(blocks)


def subtrees(pages: DataFrame) -> DataFrame:
    """Of pages (host, key, html): host, key, body (hash of the article) and hashes (of subtrees that can be template)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 256):
                part, out = frame.iloc[k : k + 256], []
                for page in part["html"]:
                    found, body = hashes(parse(page or ""))
                    out.append((body - (1 << 63), sorted({v - (1 << 63) for n, v in found.items() if n.tag not in TEXT})))
                bodies, lists = zip(*out, strict=True)
                yield pd.DataFrame({"host": part["host"].to_numpy(), "key": part["key"].to_numpy(), "body": bodies, "hashes": lists})

    return pages.where("host <> ''").select("host", "key", "html").mapInPandas(run, "host string, key long, body long, hashes array<long>")


def templates(trees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash): subtrees that enough different pages of a host have."""
    each = trees.select("host", "body", F.explode("hashes").alias("hash")).distinct()
    return each.groupBy("host", "hash").count().where(F.col("count") >= min_pages).select("host", "hash")


def extracted(pages: DataFrame, url: str = "url", page: str = "html", broadcast_hashes: int = BROADCAST_HASHES, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` plus ``text``, the main text, empty if there is none.

    A null or empty page has an empty text; a null url has no host, and so no template. Whole pages are read, of any
    length, each row by itself, repeated rows alike; an empty table gives no rows; clashing columns are replaced. The
    result is the same on either side of ``broadcast_hashes``.
    """

    @F.pandas_udf("string")
    def text(texts: pd.Series, known: pd.Series) -> pd.Series:
        kept = ((t or "", frozenset(int(x) + (1 << 63) for x in k) if k is not None else frozenset()) for t, k in zip(texts, known, strict=True))
        return pd.Series([main_text(parse(t), k) for t, k in kept], dtype=object)

    rows = pages.withColumns({"_host": host(F.col(url)), "_key": F.xxhash64(page)})
    trees = written(subtrees(rows.select(F.col("_host").alias("host"), F.col("_key").alias("key"), F.col(page).alias("html"))), "trees")
    found = written(templates(trees, min_pages), "templates")
    if found.count() <= broadcast_hashes:
        lists = F.broadcast(found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("hash").alias("_hashes")))
        joined = rows.join(lists, "_host", "left")
    else:
        own = trees.select("host", "key", F.explode("hashes").alias("hash")).distinct().join(found, ["host", "hash"])
        lists = own.groupBy(F.col("host").alias("_host"), F.col("key").alias("_key")).agg(F.collect_set("hash").alias("_hashes"))
        joined = rows.join(written(lists, "cuts"), ["_host", "_key"], "left")
    return joined.withColumn("text", text(F.col(page), F.col("_hashes"))).drop("_host", "_key", "_hashes")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
