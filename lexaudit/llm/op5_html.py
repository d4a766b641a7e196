"""Main-text extraction from HTML by minimum-cut labelling.

A page is cut into blocks of text in page order.  A logistic classifier, trained
here on the small labelled pages below, gives each block a probability of being
content; its costs become the capacities to source and sink.  Neighbours in page
order and blocks under the same element are tied by smoothness edges that weaken
with their distance in the element tree.  A maximum flow (Dinic) then separates
content from boilerplate at the least total cost.

Defined results: a null or empty page gives the empty text; markup that breaks
off is read as far as it goes; equal pages give equal texts; nothing is cut off
by length.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: element and attribute names --------------------------------------------------
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = frozenset("base head html link meta noscript script style template title".split())
#: Elements whose text no reader sees as prose.
SKIPPED_TAGS = frozenset("audio button canvas datalist head iframe map math noscript object optgroup option script select style svg template textarea title video".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
BOILER_TAGS = frozenset("aside dialog fieldset footer form menu nav".split())
BOILER_WORDS = frozenset(
    "ad ads adsense advert advertisement advertisements advertising adverts alert announcement banner breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies copyright disclaimer discussion disqus foot footer form gdpr header legal login masthead menu menus modal more nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promotion rail recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post prose story text".split())
# --------------------------------------------------------------------------------------------------

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)(>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_STOPS = re.compile(r"[.!?…]")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    boiler: bool
    content: bool
    label: int


@dataclass
class Block:
    text: str
    node: int
    link_chars: int


def blocks_of(page: str, labelled: bool = False) -> tuple[list[Node], list[Block]]:
    """Elements and text blocks in page order; only ``labelled`` (training) pages have labels in ``data-y``."""
    nodes = [Node("", -1, 0, False, False, -1)]
    found: list[Block] = []
    stack, parts, links, in_link, skipped = [0], [], 0, 0, 0
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
    at, end = 0, len(page)

    def flush():
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                found.append(Block(text, stack[-1], links))
            parts, links = [], 0

    def close(to: int):
        nonlocal skipped
        while len(stack) > to:
            tag = nodes[stack.pop()].tag
            open_at[tag].pop()
            skipped -= tag in SKIPPED_TAGS

    def index_of(tag: str) -> int:
        return open_at[tag][-1] if open_at.get(tag) else 0

    def text(a: int, b: int):
        nonlocal links
        if a < b and not skipped:
            raw = page[a:b]
            raw = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            links += len(raw) if in_link else 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(at, end)
            break
        m = _TAG.match(page, lt)
        if not m:
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag or m[4] == "":
            continue  # a comment, a declaration, or a tag that the page's end breaks off
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK_TAGS or tag in SKIPPED_TAGS:
                flush()
                if i := index_of(tag):
                    close(i)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS and tag != "hr":
            continue
        if tag == "a":
            in_link += 1
        if tag not in BLOCK_TAGS and tag not in SKIPPED_TAGS:
            if tag not in ("a", "b", "i", "em", "strong", "span") and not skipped and parts and tag == "img":
                parts.append(" ")
            continue
        flush()
        if tag not in HEAD_TAGS and (i := index_of("head")):
            close(i)
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag in BLOCK_TAGS:
            if i := index_of("p"):
                close(i)  # a block ends an open paragraph
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if tag in ("li", "dt", "dd", "tr", "td", "th") and nodes[stack[-1]].tag in same:
                close(len(stack) - 1)
            elif re.match(r"h[1-6]$", tag) and re.match(r"h[1-6]$", nodes[stack[-1]].tag):
                close(len(stack) - 1)
        if tag == "hr":
            continue
        up = nodes[stack[-1]]
        boiler, content, label, names = up.boiler or tag in BOILER_TAGS, up.content, up.label, ""
        if m[3].strip():
            for name, *values in _ATTR.findall(m[3]):
                name, value = name.lower(), values[0] or values[1] or values[2]
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    names += f" {value}"
                elif labelled and name == "data-y":
                    label = int(value)
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    boiler = True
        words = {w.lower() for w in _WORD.findall(names)}
        content |= tag in ("article", "main") or bool(words & CONTENT_WORDS)
        boiler |= bool(words & BOILER_WORDS) or (tag == "header" and not content)
        nodes.append(Node(tag, stack[-1], up.depth + 1, boiler, content, label))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(len(nodes) - 1)
        skipped += tag in SKIPPED_TAGS
        if tag in RAW_TAGS:
            closing = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = closing.end() if closing else end
            close(len(stack) - 1)
    flush()
    return nodes, found


def features(nodes: list[Node], found: list[Block]) -> np.ndarray:
    rows = []
    for b in found:
        n, size = nodes[b.node], len(b.text)
        rows.append(
            (
                1.0, n.content, n.boiler, n.content and n.boiler, min(1.0, b.link_chars / max(1, size)), min(6.0, np.log1p(size)) / 6,
                bool(_ENDS.search(b.text)), min(5, len(_STOPS.findall(b.text))) / 5, n.tag[:1] == "h" and n.tag[1:].isdigit(), n.tag in ("p", "blockquote", "pre"), n.tag in ("li", "td", "th"),
            )
        )
    return np.array(rows, float).reshape(-1, 11)


#: Labelled pages: data-y tells whether what an element holds is content (fixed values).
LABELLED = (
    '<body><nav data-y=0><ul><li><a href=x>Home</a><li><a href=x>News and politics</a></ul></nav><div class=ad data-y=0>Buy now. Only today, save a lot on all our offers.</div>'
    "<article data-y=1><h1>A long day at the harbour</h1><p>The boats came in late, and few had fish.</p><p>Short.</p><p>Later that evening, the crews met at the pier. They spoke for hours. Nobody left early.</p></article>"
    "<footer data-y=0>Copyright 2020 example.org. All rights reserved.</footer></body>",
    '<body><header data-y=0><a href=x>The Daily</a><p>News since 1900.</p></header><main data-y=1><h2>Storm</h2><p>Rain fell for two days, and the river rose. Roads closed.</p><ul><li>Two bridges are shut.<li>Trains run late.</ul>'
    '<blockquote>We have not seen this before, said the mayor.</blockquote></main><aside data-y=0><p>Most read: ten ways to cook rice. You will like them.</p></aside></body>',
    '<body><div id=cookie-notice data-y=0><p>We use cookies to improve this site. Please accept them.</p></div><div class=post-content data-y=1><p>My garden grew well this year, as it rained often.</p><p>Yes.</p><h3>Tomatoes</h3><p>They were red, round and sweet; I ate most of them.</p></div>'
    '<div class=comments data-y=0><p>Great post! I liked it very much, thank you for writing.</p><p>Me too.</p></div><form data-y=0><p>Leave a reply. Your address will not be published.</p></form></body>',
    '<body><div class=sidebar data-y=0><h3>Tags</h3><p><a href=x>garden</a> <a href=x>rain</a></p></div><div data-y=1><p>This page has no clear structure, but its paragraphs are long, end with a stop, and hold no links at all. That is enough.</p><p>Another paragraph follows it, and it also has several words and some sentences. It ends here.</p></div>'
    '<div data-y=0><a href=x>Home</a> | <a href=x>About</a> | <a href=x>Contact</a></div><div data-y=0>Login</div></body>',
    '<body><article data-y=1><header><h1>On bread</h1></header><p>Flour, water, salt. Nothing else is needed, they say.</p><div class=advert data-y=0><p>Bread knives at half price. Order yours today.</p></div><p>Ok.</p><p>Let it rest for a night, then bake it hot.</p>'
    '<div class=share data-y=0><a href=x>Share this</a></div><section class=comments data-y=0><h2>Comments</h2><p>I tried it and it worked well. Thanks a lot.</p></section></article><nav data-y=0><a href=x>Next page</a></nav></body>',
)


def train(steps: int = 3000, rate: float = 1.0, decay: float = 2e-3) -> np.ndarray:
    """Weights of the block classifier from the labelled pages; the same on every run."""
    xs, ys = [], []
    for page in LABELLED:
        nodes, found = blocks_of(page, labelled=True)
        xs.append(features(nodes, found))
        ys += [nodes[b.node].label for b in found]
    x, y = np.concatenate(xs), np.array(ys, float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + decay * w)
    return w


# --- maximum flow ----------------------------------------------------------------------------------
def source_side(n: int, edges: list[tuple[int, int, int, int]], s: int, t: int) -> list[bool]:
    """Which nodes a minimum cut leaves with s. edges: (u, v, capacity u to v, capacity v to u), whole numbers."""
    to, cap, out = [], [], [[] for _ in range(n)]
    for u, v, c, back in edges:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)
    while True:
        level, queue = [-1] * n, deque([s])
        level[s] = 0
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level]
        at, path, u = [0] * n, [], s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not cap[e])
                u = to[path[k] ^ 1]
                del path[k:]
            while at[u] < len(out[u]) and not (cap[out[u][at[u]]] > 0 and level[to[out[u][at[u]]]] == level[u] + 1):
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(out[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


SCALE = 1000


def _apart(nodes: list[Node], a: int, b: int, most: int) -> int:
    """Steps between two elements of the tree, or ``most`` if there are as many or more."""
    steps = 0
    while a != b and steps < most:
        if nodes[a].depth >= nodes[b].depth:
            a = nodes[a].parent
        else:
            b = nodes[b].parent
        steps += 1
    return steps


def labelled_blocks(page: str | None, weights: np.ndarray, smooth: float = 0.4, near: float = 0.2) -> list[tuple[str, bool]]:
    """Each block's text, and whether the cut calls it content."""
    if not page:
        return []
    nodes, found = blocks_of(page)
    if not found:
        return []
    margin = np.clip(features(nodes, found) @ weights, -12, 12)
    to_source, to_sink = np.logaddexp(0, margin) * SCALE, np.logaddexp(0, -margin) * SCALE  # costs of calling it boilerplate, content
    n = len(found)
    s, t, edges, last = n, n + 1, [], {}
    for i, b in enumerate(found):
        edges += [(s, i, int(to_source[i]), 0), (i, t, int(to_sink[i]), 0)]
        if i:
            c = int(SCALE * smooth / (1 + _apart(nodes, b.node, found[i - 1].node, int(SCALE * smooth))))  # farther than that is 0
            edges.append((i - 1, i, c, c))
        up = nodes[b.node].parent
        if up in last and last[up] < i - 1:
            c = int(SCALE * near / 2)
            edges.append((last[up], i, c, c))
        last[up] = i
    side = source_side(n + 2, edges, s, t)
    return [(b.text, side[i]) for i, b in enumerate(found)]


def main_text(page: str | None, weights: np.ndarray) -> str:
    return "\n".join(text for text, content in labelled_blocks(page, weights) if content)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` of each page with its main text and the text's number of code points."""
    weights = train()
    chosen = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return chosen.mapInArrow(run, f"{schema}, text string, n_chars long")
