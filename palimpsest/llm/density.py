"""Main text of web pages by composite text density.

Every node of a page has the characters and tags below it, C and T, and those inside links, LC and LT. Its
density is C / T, adjusted for links by a logarithm that falls as the share of linked text grows above the
whole body's (zero counts stand as one):

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LC(body) / C(body) * C + e))

The sum of a node's child densities is largest where running text is collected. Tags of all kinds count in T
and LT; children are the nearest blocks below, so that emphasis inside a paragraph is no part of its own. The main subtree is the one
of the largest sum; the smallest density on its path up to the body is the threshold, and every other
branch that reaches it is accepted. Densities only locate the article. The whole article (or main) that holds an
accepted subtree is read, with its titles in main and the articles next to it that are not mostly links. Without an article or main
all branches beside the main subtree that are not mostly links are accepted too, and all from the first to the last
accepted block is read: only lists of links before and after it are left out. Elements that are no article by their name,
role, class or id (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments) take no part. Classes and ids set no body, main or article apart and nothing that holds one, but for
comments, adverts and other articles beside the running text; words of a layout (`no-sidebar`, `comments-open`) say nothing.
Headings, paragraphs, items, quotes, tables and figures are judged by no name, nor is the header of an article but as a text of others.

Defined results: null or empty pages give an empty text; tags that are never closed end with what holds
them; a page without body is its own body; if nothing has children the body is the article. Pages of any
length are read whole; repeated rows repeat.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+", re.I)

# names of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes xmp iframe noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLES = HEADING | {"header", "hgroup"}
NO_ARTICLE = frozenset(
    "nav footer aside form script style noscript template button select option input textarea iframe object embed svg canvas "
    "head title dialog menu label fieldset audio video map".split()
)
#: Words of class, id or role that name parts around an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond "
    "related recommended recommendations widget widgets pager pagination search skip complementary contentinfo search dialog".split()
)
#: Those of them that name texts of others: readers, advertisers, other articles.
OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted sidebar aside footer comment comments disqus "
    "reply replies respond related recommended recommendations".split()
)
#: Words after these say how a page is laid out (`no-sidebar`, `has-comments`), as do words before those (`comments-open`).
LAYOUT_BEFORE = frozenset("no not without has have with".split())
LAYOUT_AFTER = frozenset("open opened closed enabled disabled".split())
#: Parts of one word that name them too, before or after a word of `PLACES` (`sitefooter`, `commentlist`).
AROUND_PARTS = ("sidebar", "footer", "comment", "advert", "navbar", "cookie", "newsletter", "breadcrumb", "sponsor")
#: Words that say where or what a part is and nothing of what it tells. Ids are often made from headings, so an id
#: names a part only if all its other words are of these (`related-posts`, not `related-work`).
PLACES = frozenset(
    "area article articles bar block box button buttons col column container content entries feed footer form global group header holder icons "
    "inner item items js left link links list main media module outer page panel post posts primary region right row secondary section  "
    "site slot stories story thread top bottom unit wrap wrapper zone s".split()
)
#: Tags that hold parts of a page; headings, paragraphs, items, quotes, tables and figures are judged by no name.
CONTAINERS = frozenset("body main article section div aside header footer nav ul ol dl center details form span a".split())
#: Tags that end an open paragraph or item of the same kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Page:
    """Nodes of a page in document order; texts hang on nodes, in order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.apart, self.held = ["html"], [-1], [False], [False]
        self.named: dict[int, frozenset[str]] = {}  # nodes whose class, id or role names a part around an article
        self.pieces: list[tuple[int, str | None]] = []  # text at a node, or None for a block edge
        self._parse(html)
        self._set_apart()

    def _open(self, tag: str, parent: int, apart: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.apart.append(apart)
        self.held.append(self.held[parent] or tag in ("article", "main"))
        return len(self.tag) - 1

    def _set_apart(self) -> None:
        """Settle which named nodes are apart, and hand that down.

        A name sets no body, main or article apart and nothing that holds a main or article. Only what is named
        as a text of others may hold articles (reader comments are articles too), and only while other running
        text of an article or main is left.
        """
        n, parent = len(self.tag), self.parent
        holds = [t in ("article", "main") for t in self.tag]
        for node in range(n - 1, 0, -1):
            holds[parent[node]] |= holds[node]
        others = []
        for node, words in self.named.items():
            if self.tag[node] in ("body", "main"):
                continue
            if not holds[node]:
                self.apart[node] = True
            elif words & OTHERS and (self.tag[node] != "article" or self.held[parent[node]]):
                others.append(node)
        if others:
            out, own = list(self.apart), set(others)
            for node in range(1, n):
                out[node] |= out[parent[node]] or node in own or self.tag[node] in HEADING or self.tag[node] == "a"
            if any(text and self.held[node] and not out[node] and not text.isspace() for node, text in self.pieces):
                for node in others:
                    self.apart[node] = True
        for node in range(1, n):
            self.apart[node] |= self.apart[parent[node]]

    def _parse(self, html: str) -> None:
        stack, at, find = [0], 0, _TOKEN.search
        tag_of, pieces = self.tag, self.pieces
        while True:
            hit = find(html, at)
            text = html[at : hit.start()] if hit else html[at:]
            if text:
                pieces.append((stack[-1], unescape(text) if "&" in text else text))
            if not hit:
                return
            at = hit.end()
            name = hit[2] or hit[5]
            if not name:
                continue
            name, closing, rest = name.lower(), hit[1] or hit[4], hit[3] or hit[6] or ""
            if closing:
                if name in BLOCK:
                    pieces.append((stack[-1], None))
                for depth in range(len(stack) - 1, 0, -1):
                    if tag_of[stack[depth]] == name:
                        del stack[depth:]
                        break
                    if name not in BLOCK and tag_of[stack[depth]] in BLOCK and tag_of[stack[depth]] != name:
                        break  # an inline end does not close blocks
                continue
            if name == "html":
                continue
            if name in BLOCK:
                pieces.append((stack[-1], None))
                self._end_paragraph(stack)
            if name in SIBLINGS:
                for depth in range(len(stack) - 1, 0, -1):
                    if tag_of[stack[depth]] in SIBLINGS[name]:
                        del stack[depth:]
                        break
                    if tag_of[stack[depth]] in SCOPES[name]:
                        break
            node = self._open(name, stack[-1], name in NO_ARTICLE or (name == "header" and not self.held[stack[-1]]) or (name != "body" and hidden(rest)))
            words = around(rest) if name in CONTAINERS else None
            if name == "header" and self.held[stack[-1]]:
                words &= OTHERS  # the title of an article
            if words:
                self.named[node] = words
            if name == "br" or name in ("td", "th"):
                pieces.append((node, " "))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif name not in VOID and not rest.endswith("/"):
                stack.append(node)
            elif name not in VOID and name in BLOCK:
                pieces.append((node, None))

    def _end_paragraph(self, stack: list[int]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == "p":
                del stack[depth:]
                return
            if tag in BLOCK or tag in ("td", "th", "button"):
                return


def marks(attributes: str) -> Iterator[tuple[str, str]]:
    for key, one, two, three in _MARK.findall(attributes):
        yield key.lower(), one or two or three


def hidden(attributes: str) -> bool:
    return any(key == "hidden" or (key == "aria-hidden" and value.lower() == "true") for key, value in marks(attributes))


def names_part(word: str) -> bool:
    """Whether a word joins a part's name and a place (`sitefooter`)."""
    for part in AROUND_PARTS:
        if word.startswith(part) and word[len(part) :] in PLACES or word.endswith(part) and word[: -len(part)] in PLACES:
            return True
    return False


def around(attributes: str) -> frozenset[str]:
    """Words of class, id or role that name a part around an article; the state of a layout is none."""
    found = set()
    for key, value in marks(attributes):
        if key in ("hidden", "aria-hidden"):
            continue
        for token in value.lower().split():
            words, named = _WORD.findall(token), set()
            for at, word in enumerate(words):
                if word in LAYOUT_BEFORE or (at + 1 < len(words) and words[at + 1] in LAYOUT_AFTER):
                    break
                if word in AROUND:
                    named.add(word)
                elif names_part(word):
                    named.add(next(part for part in AROUND_PARTS if part in word))
                elif key == "id" and word not in PLACES and not word.isdigit():
                    named.clear()
                    break
            found |= named
    return frozenset(found)


def is_block(tag: str) -> bool:
    return tag in BLOCK or tag in ("td", "th")


def densities(page: Page) -> tuple[list[float], list[float], int, list[bool]]:
    """Density and sum of child densities of every node, the body's number, and which nodes are mostly links."""
    n = len(page.tag)
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.pieces:
        if text and not page.apart[node]:
            chars[node] += len(text) - text.count(" ") - text.count("\n")
    for node in range(n - 1, 0, -1):
        if page.apart[node]:
            continue
        up = page.parent[node]
        if page.tag[node] == "a":
            linked[node], links[node] = chars[node], links[node] + 1
        chars[up] += chars[node]
        tags[up] += tags[node] + 1
        linked[up] += linked[node]
        links[up] += links[node]
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    whole = linked[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for node in range(n):
        c, t = chars[node], max(tags[node], 1)
        if not c or page.apart[node]:
            continue
        lc, lt = max(linked[node], 1), max(links[node], 1)
        base = math.log(math.log(c / max(c - linked[node], 1) * linked[node] + whole * c + math.e))
        share = math.log(max(c / lc * t / lt, 1.0))
        density[node] = c / t * (share / base if base > 1e-9 else share / 1e-9 if linked[node] else share)
        if node and is_block(page.tag[node]):
            up = page.parent[node]
            while up > 0 and not is_block(page.tag[up]):
                up = page.parent[up]
            sums[up] += density[node]
    return density, sums, body, [c > 0 and 2 * a >= c for a, c in zip(linked, chars, strict=True)]


def main_nodes(page: Page) -> tuple[list[int], list[int]]:
    """Roots of the subtrees that make the article; without an article or main around it also the nodes that hold them."""
    density, sums, body, listed = densities(page)
    within = [False] * len(page.tag)
    for node in range(len(page.tag)):
        within[node] = node == body or (node > 0 and within[page.parent[node]])
    inside = [i for i in range(len(page.tag)) if within[i] and not page.apart[i]]
    best = max(inside, key=lambda i: (sums[i], -i), default=body)
    if sums[best] <= 0:
        return [body], []
    path, at = [best], best
    while at != body:
        at = page.parent[at]
        path.append(at)
    threshold = min(density[i] for i in path)
    on_path = set(path)
    beside = [i for i in inside if i not in on_path and page.parent[i] in on_path and page.parent[i] != best]
    roots = [best] + [i for i in beside if density[i] >= threshold]
    whole = holder(page, best)
    if whole < 0:
        # its title, lead and short sections stand beside it; lists of links count only between them
        return roots + [i for i in beside if density[i] < threshold and not listed[i]], path[1:]
    # what holds a root is the article, and so are the articles next to it
    roots = [i if holder(page, i) < 0 else holder(page, i) for i in roots]
    alike = [i for i in inside if page.tag[i] == page.tag[whole] == "article" and page.parent[i] == page.parent[whole]]
    alike = [i for i in alike if not listed[i] and not page.named.get(i, frozenset()) & OTHERS]
    titles = [i for i in inside if page.tag[i] in TITLES and page.held[page.parent[i]] and page.parent[i] in on_path and page.parent[i] != best]
    return roots + alike + titles, []


def holder(page: Page, node: int) -> int:
    """The nearest article or main around a node, itself included; of articles inside one another the outermost. -1: none."""
    found = -1
    while node > 0:
        if page.tag[node] == "article" or (page.tag[node] == "main" and found < 0):
            found = node
        node = page.parent[node]
    return found


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    page = Page(html)
    roots, path = main_nodes(page)
    chosen, inside = set(roots), [False] * len(page.tag)
    for node in range(len(page.tag)):
        inside[node] = (node in chosen or (node > 0 and inside[page.parent[node]])) and not page.apart[node]
    if path:
        for node in path:  # texts of their own
            inside[node] = True
        accepted = [i for i, (node, text) in enumerate(page.pieces) if inside[node] and text and not text.isspace()]
        for node, _ in page.pieces[accepted[0] : accepted[-1]]:
            inside[node] |= not page.apart[node]
    blocks, held = [], []
    for node, text in [*page.pieces, (0, None)]:
        if text is None:
            line = " ".join("".join(held).split())
            if line:
                blocks.append(line)
            held = []
        elif inside[node]:
            held.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` of every page; no row leaves its partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
