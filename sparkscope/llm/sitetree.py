"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by the style path of their nodes. A node
is important if its presentation (the sequence of its children's styles) or
its content (its text) varies between pages; what most pages repeat is site
furniture. Names (tags, classes, roles) are a prior: importance is the tree's
evidence weighed with it, and branches of low importance go. Where a host has
too few pages the prior decides alone. Names of menus and wrappers are no veto:
such a branch that holds most of a page's text, or its article, is judged as if
it had none. Comments, notices, asides and adverts stay furniture at any size.
Pages are parsed twice rather than moved: only hashes of nodes are shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm.urls import split_url
from sparkscope.session import materialise, workers_see_package

#: Pages that must share a node before the tree judges it, importance below which it goes, and the paper's attenuation.
MIN_PAGES, MIN_IMPORTANCE, GAMMA = 4, 0.5, 0.9
#: Prior importance of furniture, of what names say nothing about, and of article and main; how far entropy alone can go.
FURNITURE, OPEN, CONTENT, LEAST, MOST = 0.01, 0.5, 0.99, 0.03, 0.95
#: Nodes that are sent to all tasks at once (8 bytes each); more are joined with the pages.
BROADCAST_NODES = 1 << 20

# Elements without content, without text, inline elements, and names of site furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
_NEVER = frozenset("head menu button select option datalist svg math canvas audio video object".split())
_STRONG = frozenset("nav footer".split())
_WEAK = frozenset("aside form dialog".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs byline-share card comment comments commentlist consent cookie cookies "
    "copyright disclaimer disqus footer gdpr login menu menubar menus modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo "
    "promos promotion promoted recommended recommendations related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe "
    "subscription teaser teasers toolbar widget widgets".split()
)
_OUTER_NAMES = frozenset("head header masthead topbar".split())
# Of these names, those whose text is no article's whatever its size and whatever stands in it, and those that wrappers of whole pages have too.
_CLOSED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners comment comments commentlist consent cookie cookies disclaimer disqus gdpr newsletter notice "
    "notices notification notifications popup promo promos promotion promoted recommended recommendations related replies reply respond share sharing social sponsor sponsored sponsors "
    "subscribe subscription teaser teasers".split()
)
_WRAPPERS = frozenset("card head header login masthead modal search widget widgets".split())
_QUALIFIERS = frozenset(
    "area bar bottom box block buttons container content element form global group icons inner item items left link links list main outer page panel primary region right secondary "
    "section site slot text top unit wrap wrapper".split()
)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_PEERS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_P_LIMITS = ("td", "th", "button", "object")
_TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol li dl dt dd figure figcaption table thead tbody tfoot tr td th caption".split())

# a tag without quotes ends in the same match; at a quote its attributes are read one by one
_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+)(>)?|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAME = re.compile(r"[\s/]*([^\s/>=]?[^\s/>=]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class _Open:
    name: str
    node: int
    rooted: bool  # inside article or main
    fixed: bool  # an article, or its text elements


@dataclass
class Page:
    """Nodes in page order (key, parent, prior and kind), child styles, and blocks (node, text) in page order."""

    key: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    firm: list[int] = field(default_factory=list)  # of furniture: 0 may wrap a page, 1 unless it holds an article, 2 whatever it holds
    root: list[bool] = field(default_factory=list)  # article and main
    styles: list[list[str]] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, key: int, parent: int, prior: float, firm: int, root: bool) -> int:
        self.key.append(key)
        self.parent.append(parent)
        self.prior.append(prior)
        self.firm.append(firm)
        self.root.append(root)
        self.styles.append([])
        return len(self.key) - 1


def _attributes(text: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """A tag's attributes and where it ends. A quoted value may have any length; a quote that never closes is part of a bare value."""
    out: dict[str, str] = {}
    n = len(text)
    while at < n:
        m = _NAME.match(text, at)
        at = m.end()
        value = ""
        if m[2]:
            quote = text[at : at + 1]
            if quote in last and at < last[quote]:
                end = text.index(quote, at + 1)
                value, at = text[at + 1 : end], end + 1
            else:
                bare = _BARE.match(text, at)
                value, at = bare[0], bare.end()
        if m[1]:
            out.setdefault(m[1].lower(), value)
        if at < n and text[at] == ">":
            return out, at + 1
    return out, n


def _furniture_words(name: str, rooted: bool) -> list[str]:
    """The words for which a class or id as a whole names furniture: the others only qualify them."""
    words = _NAMES if rooted else _NAMES | _OUTER_NAMES
    lower = name.lower()
    if lower in words:
        return [lower]
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    return [p for p in parts if p in words] if all(p in words or p in _QUALIFIERS or p.isdigit() for p in parts) else []


def _prior(tag: str, attributes: dict[str, str], rooted: bool) -> tuple[float, int]:
    """(prior importance of an element by its own names, how firm it is)"""
    if tag in _NEVER:
        return FURNITURE, 2
    if tag in _STRONG:
        return FURNITURE, 1
    named = [words for value in (attributes.get("class", ""), attributes.get("id", "")) for name in value.split() if (words := _furniture_words(name, rooted))] if attributes else []
    if tag in _WEAK or (tag == "header" and not rooted):
        closed = tag in ("aside", "dialog") or any(w in _CLOSED for words in named for w in words)
        return FURNITURE, 2 if closed else 0
    if not attributes:
        return OPEN, 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return FURNITURE, 2
    if tag in ("html", "body", "main"):
        return OPEN, 0
    role = attributes.get("role", "").lower()
    if role in _ROLES or named:
        words = [w for part in named for w in part]
        closed = role in ("alert", "alertdialog", "complementary", "dialog") or any(w in _CLOSED for w in words)
        return FURNITURE, 2 if closed else 0 if role in ("", "form", "search") and all(w in _WRAPPERS for w in words) else 1
    return OPEN, 0


def parse(text: str | None, host: str = "") -> Page:
    """A lenient, linear pass over a page; unclosed and stray tags are tolerated as browsers do."""
    page = Page()
    page.add(xxhash.xxh64_intdigest(host), -1, OPEN, 0, False)
    if not text:
        return page
    stack = [_Open("", 0, False, False)]
    where: dict[str, list[int]] = {}  # places in the stack of each name
    blocks = [0]  # places of what is not inline
    words: list[str] = []
    last = {q: text.rfind(q) for q in "\"'"}
    at, n = 0, len(text)

    def end_block() -> None:
        if words:
            content = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if content:
                page.blocks.append((stack[-1].node, content))

    def close(depth: int) -> None:
        while len(stack) > depth:
            where[stack.pop().name].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    def place(name: str) -> int:
        found = where.get(name)
        return found[-1] if found else 0

    while at < n:
        m = _MARKUP.search(text, at)
        if m is None:
            words.append(text[at:])
            break
        if m.start() > at:
            words.append(text[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name, rest = name.lower(), m[3]
        attributes: dict[str, str] = {}
        if not m[4]:
            attributes, at = _attributes(text, m.end(2), last)
            rest = "/" if text[at - 2 : at] == "/>" else ""
        elif "=" in rest or (rest and not rest.isspace() and rest.strip() != "/"):
            attributes, _ = _attributes(text, m.end(2), last)
        inline = name in _INLINE
        if m[1]:  # an end tag
            depth = place(name)
            if inline:
                if depth > blocks[-1]:
                    if stack[depth].node != stack[depth - 1].node:
                        end_block()
                    close(depth)
                continue
            end_block()
            if depth:
                close(depth)
            continue
        if not inline:
            end_block()
            if name in _CLOSES_P:
                depth = place("p")
                if depth and depth > max(map(place, _P_LIMITS)):
                    close(depth)
            elif name in _SELF_CLOSING:
                depth = max(map(place, _PEERS.get(name, (name,))))
                if depth and depth > max(map(place, _SELF_CLOSING[name])):
                    close(depth)
        top = stack[-1]
        if name in _RAW:
            ended = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            at = ended.end() if ended else n
            continue
        if name in _VOID or (inline and rest.endswith("/")):
            continue
        root = name in ("article", "main") or attributes.get("role") == "main"
        prior, firm = _prior(name, attributes, top.rooted or root)
        node, fixed = top.node, top.fixed
        if not inline or prior == FURNITURE:
            if inline:
                end_block()
            style = name + "".join("." + c for c in sorted(attributes.get("class", "").split()))
            fixed = root or (top.fixed and name in _TEXT_TAGS)
            own = CONTENT if fixed and prior == OPEN else prior
            node = page.add(xxhash.xxh64_intdigest(style, page.key[top.node]), top.node, own, firm, root and prior == OPEN)
            children = page.styles[top.node]
            if not children or children[-1] != style:
                children.append(style)
        if not inline:
            blocks.append(len(stack))
        where.setdefault(name, []).append(len(stack))
        stack.append(_Open(name, node, top.rooted or root, fixed))
    end_block()
    return page


def importance(evidence: float, prior: float) -> float:
    """The tree's evidence (0 to 1, 0.5 for none) weighed with the prior, as odds are."""
    evidence = min(max(evidence, LEAST), MOST)
    return evidence * prior / (evidence * prior + (1 - evidence) * (1 - prior))


def judged(page: Page) -> list[float]:
    """Prior importance of each node, given what the page holds.

    Comments, notices, asides, adverts and the like are furniture whatever they
    hold. Other furniture that holds most of the rest of the text counts as
    open if it holds an article or, where it may wrap a page, if the page has
    none. If articles hold most of the other text, what stands outside them
    counts as furniture.
    """
    n = len(page.key)
    size, articles = [0] * n, [0] * n
    for node, text in page.blocks:
        size[node] += len(text)
    for i in range(n - 1, 0, -1):  # parents come before their children
        if page.prior[i] != FURNITURE or page.firm[i] < 2:
            size[page.parent[i]] += size[i]
            articles[page.parent[i]] += articles[i] + page.root[i]
    prior = list(page.prior)
    for i in range(1, n):
        if prior[i] == FURNITURE and page.firm[i] < 2 and 2 * size[i] > size[0] and (articles[i] if page.firm[i] == 1 else not page.firm[i] and (articles[i] or not articles[0])):
            prior[i] = OPEN
    inside, kept = [False] * n, [True] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.root[i]
        kept[i] = kept[page.parent[i]] and prior[i] != FURNITURE
    total = sum(len(text) for node, text in page.blocks if kept[node])
    own = sum(len(text) for node, text in page.blocks if kept[node] and inside[node])
    if own and 2 * own >= total:
        for i in range(1, n):
            if not inside[i] and not articles[i]:
                prior[i] = FURNITURE
    return prior


def decided(page: Page, evidence: dict[int, float], min_importance: float = MIN_IMPORTANCE) -> list[bool]:
    """Whether each node stays: no node on its way from the root is below the least importance.

    If the tree's evidence leaves nothing of a page, the priors decide alone.
    """
    prior = judged(page)

    def stays(known: dict[int, float]) -> list[bool]:
        out = [True] * len(prior)
        for i in range(1, len(prior)):
            out[i] = out[page.parent[i]] and importance(known.get(page.key[i], 0.5), prior[i]) >= min_importance
        return out

    kept = stays(evidence)
    return kept if any(kept[node] for node, _ in page.blocks) else stays({})


def main_text(text: str | None, evidence: dict[int, float], host: str = "", min_importance: float = MIN_IMPORTANCE) -> str:
    page = parse(text, host)
    kept = decided(page, evidence, min_importance)
    return " ".join(content for node, content in page.blocks if kept[node])


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def _node_rows(text: str | None, host: str) -> list[tuple[int, int, int, int]]:
    """(node, kind, value, page) of all branches of a page: kind 0 is a block's text, 1 a node's child styles; equal pages have the same page value."""
    page = parse(text, host)
    own = _hash("\n".join(content for _, content in page.blocks))
    rows = {(page.key[node], 0, _hash(content)) for node, content in page.blocks}
    rows |= {(key, 1, _hash(",".join(s))) for key, s in zip(page.key, page.styles, strict=True) if s}
    return [(*r, own) for r in rows]


def _signed(values: Iterable[int]) -> pa.Array:
    return pa.array(np.array(list(values), np.uint64).view(np.int64))


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES, gamma: float = GAMMA) -> DataFrame:
    """(node, pages, evidence): importance of the nodes of all hosts that ``min_pages`` different pages share, names apart.

    Content importance is 1 minus the mean of log_m(pages with this text) over a
    node's occurrences, presentation importance the entropy of its child styles
    to the base m, for m occurrences; they are weighted gamma and 1 - gamma.
    Nodes that hold no text of their own have presentation only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True) for r in _node_rows(h, split_url(u)[0])]
            node, kind, value, page = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([_signed(node), pa.array(kind, pa.int8()), _signed(value), _signed(page)], ["node", "kind", "value", "page"])

    found = pages.select("url", "html").mapInArrow(run, "node long, kind byte, value long, page long").distinct()
    values = found.groupBy("node", "kind", "value").agg(F.count("*").alias("n"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    shares = values.groupBy("node").agg(
        of(0, F.col("n")).alias("m"), of(0, F.col("n") * F.log("n")).alias("common"), of(1, F.col("n")).alias("s"), of(1, F.col("n") * F.log("n")).alias("styled")
    )
    content = 1 - F.col("common") / F.col("m") / F.log("m")
    style = F.when(F.col("s") > 1, (F.log("s") - F.col("styled") / F.col("s")) / F.log("s")).otherwise(0.0)
    judged_ = shares.where(F.col("m") >= min_pages).select("node", F.col("m").alias("pages"), (gamma * content + (1 - gamma) * style).alias("evidence"))
    return judged_


def extract_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    min_importance: float = MIN_IMPORTANCE,
    gamma: float = GAMMA,
    broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """(page_id, url, text, n_chars, n_branches, n_removed): the main text of each page, its branches and those removed.

    Null and empty html give an empty text; null URLs share the empty host;
    repeated rows are extracted alike and equal pages count once in the tree;
    extra columns are ignored.
    """
    workers_see_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    # of the tree, tasks need the nodes whose evidence can turn the prior's verdict: an open node's if it is low, furniture's if it is high
    turning = (F.col("evidence") < _turning(OPEN, min_importance)) | (F.col("evidence") >= _turning(FURNITURE, min_importance))
    low = materialise(style_tree(rows, min_pages, gamma).where(turning).select("node", "evidence"))
    schema = "page_id long, url string, text string, n_chars long, n_branches long, n_removed long"

    def extracted(batch: pa.RecordBatch, evidence: Iterable[dict[int, float]]) -> pa.RecordBatch:
        out = []
        for url, html, known in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), evidence, strict=True):
            page = parse(html, split_url(url)[0])
            kept = decided(page, known, min_importance)
            text = " ".join(content for node, content in page.blocks if kept[node])
            out.append((text, len(text), len(kept) - 1, sum(not k and kept[p] for k, p in zip(kept[1:], page.parent[1:], strict=True))))
        columns = zip(*out, strict=True) if out else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *arrays], ["page_id", "url", "text", "n_chars", "n_branches", "n_removed"])

    if low.count() <= broadcast_nodes:
        table = low.toArrow()
        known = dict(zip(table["node"].to_numpy().view(np.uint64).tolist(), table["evidence"].to_pylist(), strict=True))
        sent = pages.sparkSession.sparkContext.broadcast(known)

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            evidence = sent.value
            for batch in batches:
                yield extracted(batch, [evidence] * batch.num_rows)

        return rows.mapInArrow(whole, schema)

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [{*parse(h, split_url(u)[0]).key} for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            own = np.repeat(batch.column("row").to_numpy(), [len(p) for p in parsed])
            yield pa.RecordBatch.from_arrays([pa.array(own), _signed(k for p in parsed for k in p)], ["own", "key"])

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = ({e["node"] % (1 << 64): e["evidence"] for e in found or ()} for found in batch.column("found").to_pylist())
            yield extracted(batch, maps)

    # a page's nodes are looked up one by one, so neither a host's pages nor its nodes meet in one place
    numbered = rows.withColumn("row", F.xxhash64("url", "html"))
    looked = numbered.mapInArrow(nodes, "own long, key long").distinct().join(low, F.col("key") == F.col("node"))
    lists = looked.groupBy("own").agg(F.collect_list(F.struct("node", "evidence")).alias("found"))
    return numbered.join(lists, F.col("row") == F.col("own"), "left").select("page_id", "url", "html", "found").mapInArrow(listed, schema)


def _turning(prior: float, least: float) -> float:
    """Evidence from which a node of this prior has the least importance; above 1 if none is enough."""
    odds = least / (1 - least) * (1 - prior) / prior
    turn = odds / (1 + odds)
    return turn if turn <= MOST else 2.0
