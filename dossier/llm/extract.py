"""Main text of web pages: boosted trees over the nodes of the page's tree.

Every block element gets features of its subtree (density of text and links), its attribute
tokens, its depth and its siblings. Boosted trees judge each node; then the tree is decoded
as a whole, so that nothing is kept below a dropped node.

The trees are trained on pages of the table itself. Some pages mark their article; those are
read three times: as they are, with the marks replaced by common class names, and by bare
boxes, with boxes of other kinds put in. So nodes can be judged that carry no such mark.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_named

# Bound of the training sample: pages, and bytes of a page that may take part.
TRAIN_PAGES = 400
TRAIN_BYTES = 100_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg math".split())
HEAD = frozenset("head title".split())
BLOCK = frozenset(
    "html body head title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul select option textarea button label video audio canvas".split()
)
# Opening one of these closes an open p; li, dt, dd, option, tr and cells close their like.
CLOSES_P = BLOCK - frozenset("html body head title tbody td tfoot th thead tr select option textarea button label video audio canvas".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "body": ("head", "title"),
}
SCOPE = frozenset("html body div article section main aside nav header footer table ul ol dl form td th blockquote".split())

# Tokens in tags, classes, ids and roles that speak against and for main text.
AGAINST = frozenset(
    "ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs button comment comments consent cookie cookies "
    "copyright discussion disqus footer form header hidden legal login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted recommended related replies reply respond rail search share sharing "
    "sidebar sidebars signup social sponsor sponsored subscribe tags teaser toolbar top topbar widget widgets aside alert "
    "complementary contentinfo banner select option textarea label fieldset dialog".split()
)
FOR = frozenset("article articlebody body content copy entry main maincontent page post prose story text".split())

TAG = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
TOKEN = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    mark: str = ""  # training only
    children: list[int] = field(default_factory=list)
    own: int = 0  # characters of text in the node itself
    links: int = 0  # of these, inside links
    stops: int = 0  # sentence ends
    tags: int = 1


def _tokens(tag: str, raw: str) -> tuple[tuple[str, ...], str]:
    found, mark = [], ""
    for name, a, b, c, bare in ATTRIBUTE.findall(raw):
        value = a or b or c
        if bare:
            found.append("hidden")
        elif name.lower() in ("class", "id", "role", "itemprop"):
            found += TOKEN.findall(CAMEL.sub(" ", value).lower())
        elif name.lower() == "style" and "none" in value and "display" in value:
            found.append("hidden")
        elif name.lower() == "aria-hidden" and value == "true":
            found.append("hidden")
        elif name == "data-mark":
            mark = value
    return tuple(found), mark


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes of a page in order (the root first), and its text blocks with their node."""
    nodes = [Node("#root", -1, 0)]
    blocks: list[tuple[int, str]] = []
    stack = [0]  # open nodes
    buffer: list[str] = []
    link = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            n = nodes[stack[-1]]
            n.own += len(text)
            n.links += min(linked, len(text))
            n.stops += sum(map(text.count, ".!?"))
            blocks.append((stack[-1], text))
        linked = 0

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            buffer.append(page[at:lt])
            linked += (lt - at) if link else 0
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        name = NAME.match(page, lt)
        if not name:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                buffer.append("<")
                at = lt + 1
            continue
        whole = TAG.match(page, name.end())
        end = whole.end() if whole else page.find(">", name.end()) + 1
        if end <= 0:
            break
        tag, closing = name[1].lower(), page[lt + 1] == "/"
        raw, at = page[name.end() : end - 1], end
        if not closing and tag in SILENT:
            if not raw.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else size
            nodes[stack[-1]].tags += 1
            buffer.append(" ")
            continue
        if tag not in BLOCK:
            nodes[stack[-1]].tags += not closing
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                link = 0 if closing else 1
            continue
        flush()
        link = 0
        if closing:
            if tag == "p" and not any(nodes[i].tag == "p" for i in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
                if tag == "p" and nodes[stack[k]].tag in SCOPE:
                    break
            continue
        shut = CLOSES.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
        for k in range(len(stack) - 1, 0, -1):
            if nodes[stack[k]].tag in shut:
                del stack[k:]
                break
            if nodes[stack[k]].tag in SCOPE and not (tag in ("td", "th", "tr") and nodes[stack[k]].tag in ("td", "th")):
                break
        tokens, mark = _tokens(tag, raw)
        nodes.append(Node(tag, stack[-1], len(stack), tokens, mark))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if tag not in VOID and not raw.endswith("/"):
            stack.append(len(nodes) - 1)
    flush()
    return nodes, blocks


FEATURES = 19


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.array([x.own for x in nodes], dtype=float)
    total, links, stops, tags = own.copy(), np.array([x.links for x in nodes], float), np.array([x.stops for x in nodes], float), np.array([x.tags for x in nodes], float)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        links[p] += links[i]
        stops[p] += stops[i]
        tags[p] += tags[i]
    against = np.array([sum(t in AGAINST for t in (x.tag, *x.tokens)) for x in nodes], float)
    favour = np.array([sum(t in FOR for t in (x.tag, *x.tokens)) - (x.tag == "body") for x in nodes], float)
    above_a, above_f = np.zeros(n), np.zeros(n)
    position, siblings, like, mean, index = (np.zeros(n) for _ in range(5))
    for i, x in enumerate(nodes):
        for k, c in enumerate(x.children):
            above_a[c] = above_a[i] + against[i]
            above_f[c] = above_f[i] + favour[i]
            position[c] = (k + 1) / len(x.children)
            index[c] = k
            siblings[c] = len(x.children)
        if x.children:
            kids = np.array(x.children)
            mean[kids] = total[kids].mean()
            names = [nodes[c].tag for c in x.children]
            count = {t: names.count(t) for t in set(names)}
            like[kids] = [count[t] / len(names) for t in names]
    page = max(total[0], 1.0)
    kind = np.array([0 if x.tag == "p" else 1 if x.tag[0] == "h" and x.tag[1:].isdigit() else 2 if x.tag in ("li", "td", "th", "dd", "dt") else 3 for x in nodes], float)
    up = np.maximum(parent, 0)
    cols = [
        np.array([x.depth for x in nodes], float), against, favour, above_a, above_f, np.log1p(total), np.log1p(own),
        total / page, links / np.maximum(total, 1), total / tags, stops / np.maximum(total, 1) * 100, position,
        np.minimum(siblings, 50), like, np.log1p(mean), total / np.maximum(total[up], 1), kind, np.minimum(index, 50),
        links[up] / np.maximum(total[up], 1),
    ]
    return np.stack(cols, 1)


@dataclass
class Trees:
    """Boosted trees of a fixed depth, stored as arrays: feature, limit and value of each node."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of main text."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, c, v in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting on logistic loss, with splits at quantiles."""
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    binned = np.stack([np.searchsorted(cuts[:, j], x[:, j], side="left") for j in range(x.shape[1])], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = math.log(share / (1 - share))
    margin = np.full(len(y), base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    trees = Trees(base, np.zeros((TREES, inner), int), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first = 2**depth - 1
            for k in range(first, 2 * first + 1):
                inside = np.flatnonzero(node == k)
                best = (1e-6, 0, np.inf, 0)
                for j in range(x.shape[1]):
                    if not len(inside):
                        break
                    b = binned[inside, j]
                    gs, hs = (np.bincount(b, weights=w[inside], minlength=BINS).cumsum()[:-1] for w in (g, h))
                    rest_g, rest_h = g[inside].sum() - gs, h[inside].sum() - hs
                    gain = gs**2 / (hs + 1) + rest_g**2 / (rest_h + 1) - g[inside].sum() ** 2 / (h[inside].sum() + 1)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], j, cuts[at, j], at)
                _, trees.feature[t, k], trees.limit[t, k], _ = best
            node = 2 * node + 1 + (x[np.arange(len(y)), trees.feature[t][node]] > trees.limit[t][node])
        leaf = node - inner
        sums = [np.bincount(leaf, weights=w, minlength=leaves) for w in (g, h)]
        trees.value[t] = RATE * sums[0] / (sums[1] + 1)
        margin = margin + trees.value[t][leaf]
    return trees


def _variants(page: str, seed: int) -> Iterator[str]:
    """A page with a marked article as it is, with other names, and with bare boxes."""
    opening = re.search(r"<(article|main)\b[^>]*>", page, re.I)
    if not opening:
        return
    tag = opening[1]
    closing = page.lower().rfind(f"</{tag.lower()}>")
    if closing < 0:
        return
    before, inside, after = page[: opening.start()], page[opening.end() : closing], page[closing + len(tag) + 3 :]
    bad = sorted(AGAINST)
    good = ["content", "post-body", "entry", "story", "article-text", "main"]
    words = html.unescape(re.sub(r"<[^>]*>", " ", inside)).split() or ["text"]

    def box(k: int, plain: bool = False) -> str:
        name = bad[(seed * 7 + k * 13) % len(bad)]
        some = " ".join(words[(seed + 5 * k) % len(words) :][: 4 + (seed * 3 + k * 5) % 40])
        body = f"<p>{html.escape(some)}</p>" if k % 2 else f"<ul><li><a href=x>{html.escape(some)}</a></li></ul>"
        tag = ("aside", "form", "header", "nav", "footer", "section")[(seed + k) % 6] if k % 3 == 0 else "div"
        where = "" if plain else f' class="{name}"' if k % 2 else f' id="{name}-{k}"'
        return f'<{tag}{where} data-mark="0">{body}</{tag}>'

    yield f'{before}<{tag} data-mark="1">{inside}</{tag}>{after}'
    name = good[seed % len(good)]
    yield f'{before}{box(1)}{box(3)}<div class="{name}" data-mark="1">{inside}{box(2)}</div>{box(4)}{box(6)}{after}'
    stripped = [re.sub(r"\s(?:class|id|role)=(\"[^\"]*\"|'[^']*'|\S+)", "", part) for part in (before, after)]
    yield f'{stripped[0]}<div>{box(9)}<div data-mark="1">{inside}</div></div>{box(5)}{stripped[1]}'


def _training_rows(page: str, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for variant in _variants(page, seed):
        nodes, _ = parse(variant)
        label = np.full(len(nodes), -1)
        for i, n in enumerate(nodes):
            if n.parent >= 0 and label[n.parent] >= 0 and not n.mark:
                label[i] = label[n.parent]
            elif n.mark:
                label[i] = int(n.mark)
            elif n.tag in AGAINST or any(t in AGAINST for t in n.tokens) or n.tag in HEAD:
                label[i] = 0
        x = features(nodes)
        # What holds both kinds has no label.
        use = (label >= 0) & (x[:, 5] > 0)
        yield x[use], label[use]


def train(pages: DataFrame, limit: int = TRAIN_PAGES) -> Trees | None:
    """Trees from a bounded sample of pages that mark their article; ``None`` without such pages.

    Pages are drawn by the hash of their id, at most ``limit`` of them; nodes become features
    where the pages are, and only these come to the driver.
    """
    rows = column_named(pages, "page_id", "html").filter(
        (F.octet_length("html") <= TRAIN_BYTES) & F.col("html").rlike(r"(?i)<(?:article|main)\b")
    )
    drawn = rows.select(F.xxhash64("page_id").alias("k"), "html").orderBy("k").limit(limit)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x, y in _training_rows(page, k % 100_003):
                    yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    found = drawn.mapInArrow(featured, "x array<double>, y int").toPandas()
    if found.empty or found.y.nunique() < 2:
        return None
    x, y = np.array(found.x.to_list()), found.y.to_numpy(dtype=float)
    # A fixed order, as rows may come in any.
    order = np.lexsort((*x.T, y))
    return boost(x[order], y[order])


def decode(nodes: list[Node], margin: np.ndarray) -> np.ndarray:
    """Nodes to keep: the best choice in which nothing is kept below a dropped node."""
    m = np.clip(margin, -4, 4)
    keep, drop = -np.log1p(np.exp(-m)), -np.log1p(np.exp(m))
    n = len(nodes)
    for i in range(n):
        if nodes[i].tag in ("#root", "html", "body"):
            keep[i], drop[i] = 0.0, 0.0
        elif nodes[i].tag in HEAD:
            keep[i], drop[i] = -1e9, 0.0
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(n, dtype=bool)
    for i in range(n):
        p = nodes[i].parent
        kept[i] = (p < 0 or kept[p]) and (i == 0 or keep[i] > drop[i])
    return kept


def rule_margin(nodes: list[Node]) -> np.ndarray:
    """Judgement by names alone, where no page taught any better."""
    x = features(nodes)
    return np.where(x[:, 1] + x[:, 3] > 0, -3.0, 3.0)


def main_text(page: str | None, trees: Trees | None) -> str:
    """Kept blocks in page order, one per line."""
    nodes, blocks = parse(page or "")
    kept = decode(nodes, trees.margin(features(nodes)) if trees else rule_margin(nodes))
    return "\n".join(text for node, text in blocks if kept[node])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per page.

    Null and empty pages, and pages without main text, give an empty text. Pages are read
    whole; repeated rows are extracted one by one.
    """
    trees = train(pages)
    rows = column_named(pages, "page_id", "url", "html")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(h or "") for h in batch.column(2).to_pylist()]
            x = [features(nodes) for nodes, _ in parsed]
            if trees:
                ends = np.cumsum([len(f) for f in x])
                margins = np.split(trees.margin(np.concatenate(x)), ends[:-1]) if x else []
            else:
                margins = [rule_margin(nodes) for nodes, _ in parsed]
            texts = []
            for (nodes, blocks), m in zip(parsed, margins, strict=True):
                kept = decode(nodes, m)
                texts.append("\n".join(text for node, text in blocks if kept[node]))
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch(cols, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
