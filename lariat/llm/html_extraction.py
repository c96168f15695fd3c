"""HTML extraction by consensus host paths: every page scores its containers, each host's pages vote on generalised tag-class paths in Spark, and pages are extracted again by their host's winning path."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import kept_names, materialise, ship

#: Winning paths of at most so many hosts are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 500_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
# A name starts where none goes on, so that a long run of other characters is tried once.
_ATTRIBUTE = re.compile(r"""(?<![^\s"'<>/=])([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPACE = re.compile(r"\s+")
# Element kinds of HTML.
RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html head option legend caption tbody td tfoot th thead tr".split())
CONTAINERS = frozenset("article body div main section td".split())
PROSE = frozenset("p blockquote pre h1 h2 h3".split())
# What an element ends when it starts: the outermost open one of the first set, up to the nearest of the second.
FAMILIES = (({"p"}, CONTAINERS), ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}, ), ({"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"}))
IMPLIED = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_IN_FAMILY = {t: [(i, t in fences) for i, (ended, fences) in enumerate(FAMILIES) if t in ended or t in fences] for t in set().union(*(a | b for a, b in FAMILIES))}
#: Never part of the text.
HARD = frozenset("script style head title noscript template iframe button select textarea svg canvas object".split())
#: Not part of the article, unless they hold it.
SOFT = frozenset("nav header footer aside form dialog menu search".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related recommended remark remarks replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
REMARKS = frozenset("comment comments disqus remark remarks replies reply respond".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# A class counts as hint if it is one, ends in one (site-header), or starts with one and goes on with one of these (sidebar-left); has-sidebar, header-fixed or social-science say nothing of the element itself.
SUFFIXES = frozenset("area bar block body bottom box btn button buttons column container content form group holder icons inner item items left link links list module panel post posts primary region right row secondary section slot stories text title top unit wrap wrapper".split())
MODIFIERS = frozenset("allow allows had has hide is no non not show support supports with without".split())
# Text of an article whatever its class: hints do not drop these inside a container named as content, and outside only by their whole class.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6".split())
GOOD = frozenset("article articlebody body content entry main post story text".split())


def _hinted(token: str, whole: bool = False) -> str:
    """The hint in a class name, or nothing."""
    if token in HINTS:
        return token
    parts = [p for p in re.split(r"[-_:]+", token) if p]
    if whole or len(parts) < 2 or parts[0] in MODIFIERS:
        return ""
    return parts[-1] if parts[-1] in HINTS else parts[0] if parts[0] in HINTS and parts[-1] in SUFFIXES else ""


class Node:
    __slots__ = ("tag", "parent", "label", "key", "hard", "soft", "out", "link", "good", "within", "remark", "size", "chars", "linked", "prose", "named", "depth", "index", "near")

    def __init__(self, tag: str, parent: Node | None, attributes: str, index: int):
        self.tag, self.parent, self.index = tag, parent, index
        self.depth = parent.depth + 1 if parent else 0
        self.link = bool(parent and parent.link) or tag == "a"
        self.size = 0
        self.label, self.good = tag, tag in ("article", "main")
        self.within = bool(parent and (parent.within or parent.good))
        self.remark = bool(parent and parent.remark)
        self.hard = bool(parent and parent.hard) or tag in HARD
        self.soft = tag in SOFT
        if attributes and "=" in attributes:
            a = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            classes, role = a.get("class", "").lower().split(), a.get("role", "").lower()
            if classes:
                self.label += "." + ".".join(sorted({re.sub(r"\d+", "#", c) for c in classes}))
            named = [*classes, *a.get("id", "").lower().split(), *a.get("itemprop", "").lower().split()]
            if named or role:
                hints = {h for c in named if (h := _hinted(c, tag in TEXTUAL))}
                self.remark |= bool(hints & REMARKS) and tag not in ("html", "body", "main")
                if tag not in ("html", "body", "article", "main"):
                    self.soft |= bool(hints) and not (self.within and tag in TEXTUAL) or role in ROLES
                elif tag == "article":
                    self.soft |= bool(hints & REMARKS)
                self.good |= role in ("main", "article") or any(p in GOOD for c in named for p in (c, *re.split(r"[-_:]+", c)))
        self.good &= not self.remark and not self.hard

    def path(self) -> str:
        parts, n = [], self
        while n is not None:
            parts.append(n.label)
            n = n.parent
        return "/".join(reversed(parts[:-1])) if len(parts) > 1 else parts[0]


Page = tuple[list[Node], list[tuple[Node, str, int]]]


def parse(html: str) -> Page:
    """(nodes, parents first; (node, text, number of its block) in page order), without what never counts. Raw text elements end at their own end tag only; end tags without a start are skipped; unclosed elements end with the page.

    One pass: places in the page only move forward, and what a tag ends is known from where it stands, so time is linear in the page's length.
    """
    root = Node("#page", None, "", 0)
    root.near = (-1,) * len(FAMILIES)
    nodes, stack, out, opened = [root], [root], [], Counter()
    at, block, n, pos = 0, 0, len(html), 0
    unclosed: set[str] = set()  # quotes that do not occur any more

    def text(a: int, b: int) -> None:
        if b > a and not stack[-1].hard:
            out.append((stack[-1], html[a:b], block))

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while True:
        pos = html.find("<", pos)
        if pos < 0:
            break
        ending = html.startswith("/", pos + 1)
        m = _NAME.match(html, pos + 1 + ending)
        if not m:
            if html.startswith("<!--", pos):
                end = html.find("-->", pos + 4)
                end = n if end < 0 else end + 3
            elif html.startswith(("<!", "<?"), pos):
                end = html.find(">", pos) + 1
            else:
                pos += 1
                continue
            if not end:
                break
            text(at, pos)
            pos = at = end
            continue
        end = m.end()
        while True:
            s = _STOP.search(html, end)
            if not s or s[0] == ">":
                break
            close_at = -1 if s[0] in unclosed else html.find(s[0], s.end())
            if close_at < 0:
                unclosed.add(s[0])
            end = s.end() if close_at < 0 else close_at + 1
        if not s:  # no tag ends any more
            break
        text(at, pos)
        attributes, tag = html[m.end() : s.start()], m[0].lower()
        pos = at = s.end()
        if tag in BLOCK:
            block += 1
        if ending:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in VOID:
            if tag != "wbr" and not stack[-1].hard:
                out.append((stack[-1], " ", block))
            continue
        if tag in CLOSES_P and (k := stack[-1].near[0]) >= 0:
            close(k)
        if tag in IMPLIED and (k := stack[-1].near[IMPLIED[tag]]) >= 0:
            close(k)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, pos)
            end = html.find(">", found.end()) + 1 if found else 0
            pos = at = end or n
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            node = Node(tag, stack[-1], attributes, len(nodes))
            near = stack[-1].near
            if tag in _IN_FAMILY:
                near = list(near)
                for i, fence in _IN_FAMILY[tag]:
                    near[i] = -1 if fence else near[i] if near[i] >= 0 else len(stack)
            node.near = near
            nodes.append(node)
            stack.append(node)
            opened[tag] += 1
    text(at, n)
    for node, t, _ in out:
        node.size += len(t) - t.count(" ") if not t.isspace() else 0
    _drop(nodes)
    return nodes, out


def _sum(nodes: list[Node]) -> None:
    """Characters of each node's subtree, those in links, those of prose, and prose inside containers named as content; without what is out."""
    for x in nodes:
        x.chars = 0 if x.out else x.size
        x.linked, x.prose, x.named = x.chars * x.link, 0, 0
    for x in reversed(nodes):
        if x.tag in PROSE:
            x.prose = x.chars - x.linked
        if x.good and not x.out:
            x.named = x.prose
        if x.parent is not None:
            up = x.parent
            up.chars += x.chars
            up.linked += x.linked
            up.prose += x.prose
            up.named += x.named


def _drop(nodes: list[Node]) -> None:
    """Set what is out: elements that are not part of the article by kind, role or class; but one that holds the article is not dropped, whatever its name: half of the page's prose inside containers named as content, or nearly all prose while nothing so named has any outside (readers' comments never stand in for an article)."""
    for x in nodes:
        x.out = x.hard
    _sum(nodes)
    prose, named = nodes[0].prose, nodes[0].named
    for x in nodes:
        holds = prose and (2 * x.named >= prose or (not x.remark and 5 * x.prose >= 4 * prose and x.named == named))
        x.out = x.hard or (x.parent is not None and x.parent.out) or (x.soft and not holds)
    _sum(nodes)


def best_container(nodes: list[Node]) -> Node | None:
    """The deepest container that loses nothing but links: of all text that the containers named as content hold where one of them has half of the page's weight, else of the page's."""
    found = [x for x in nodes if x.chars and (x.tag in CONTAINERS or x.parent is None)]
    if not found:
        return None
    weigh = lambda c: (c.prose + 0.1 * (c.chars - c.linked)) * (1 - 0.5 * c.linked / max(1, c.chars))
    top = max(map(weigh, found))
    best = max(found, key=lambda c: (c.chars - c.linked, -c.depth))
    if any(c.good and weigh(c) >= 0.5 * top for c in found):
        # The least container around all outermost ones with prose.
        outer = [c for c in found if c.good and not c.within and c.prose] or [c for c in found if c.good and not c.within]
        below = [0] * len(nodes)
        for c in outer:
            below[c.index] += 1
        for x in reversed(nodes):
            if x.parent is not None:
                below[x.parent.index] += below[x.index]
        best = max((c for c in found if below[c.index] == len(outer)), key=lambda c: c.depth, default=best)
    whole, inside = best.chars - best.linked, [False] * len(nodes)
    for x in nodes:
        inside[x.index] = x is best or (x.parent is not None and inside[x.parent.index])
    return max((c for c in found if inside[c.index] and c.chars - c.linked == whole), key=lambda c: (c.depth, c.chars))


def keyed(nodes: list[Node]) -> None:
    """Give every node a 64-bit digest of its path."""
    import xxhash

    for x in nodes:
        x.key = xxhash.xxh3_64_intdigest(f"{x.parent.key if x.parent is not None else 0}/{x.label}")


def render(page: Page, chosen: set[int]) -> str:
    """Blocks of the pieces below the chosen nodes, given by their number."""
    nodes, pieces = page
    inside = [False] * len(nodes)
    for x in nodes:
        inside[x.index] = x.index in chosen or (x.parent is not None and inside[x.parent.index])
    blocks: list[list[str]] = []
    last = None
    for node, t, block in pieces:
        if inside[node.index] and not node.out:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(t)
    texts = (_SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def propose(html: str | None) -> tuple[str | None, int | None, float]:
    """The page's vote: its best container's path, the digest of that, and the container's characters of prose."""
    nodes, _ = parse(html or "")
    best = best_container(nodes)
    if best is None:
        return None, None, 0.0
    keyed(nodes)
    return best.path(), _signed(best.key), float(best.prose)


def extract(html: str | None, key: int | None) -> str:
    """Text by the host's path, given by its digest, where it holds more than links; a page without it, or without text there, goes by its own best container."""
    page = parse(html or "")
    nodes = page[0]
    chosen = []
    if key is not None:
        keyed(nodes)
        chosen = [c for c in nodes if c.chars > c.linked and _signed(c.key) == key and (c.tag in CONTAINERS or c.parent is None)]
    if not chosen:
        best = best_container(nodes)
        chosen = [best] if best is not None else []
    return render(page, {c.index for c in chosen}) if chosen else ""


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, key, votes, pages): the path with most votes of each host, ties by characters, then by path. Votes combine before the shuffle, so a host of a third of all pages is no burden."""
    ship(pages.sparkSession)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [propose(h) for h in b["html"]]
            yield pd.DataFrame({"host": b["host"], "path": [p for p, *_ in got], "key": pd.array([k for _, k, _ in got], dtype="Int64"), "chars": [c for *_, c in got]})

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInPandas(vote, "host string, path string, key bigint, chars double")
    counts = votes.where("path is not null").groupBy("host", "path", "key").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    best = F.max(F.struct("votes", "chars", "path", "key"))
    return counts.groupBy("host").agg(best.alias("b"), F.sum("votes").alias("pages")).select("host", "b.path", "b.key", "b.votes", "pages")


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The kept columns (default page_id and url), text, n_chars and path (the host's) of every page.

    Null html is empty and gives the empty text; a null url votes under the empty host; repeated pages vote and are extracted each; an empty table gives no rows. Kept columns may have any names: one named text, n_chars or path gets an underscore at its end. Nothing is cut: very long pages are parsed whole, in time linear in their length, and elements nested to any depth need no recursion.
    """
    keep = ["page_id", url] if keep is None else keep
    paths = materialise(winning_paths(pages, html, url).select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("key").alias("__key")))
    small = paths.count() <= broadcast_hosts
    rows = pages.select(*[pages[c].alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("__h"), F.col(html).alias("__html"))
    rows = rows.join(F.broadcast(paths) if small else paths, F.col("__h") == F.col("__host"), "left")
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [extract(h, None if pd.isna(k) else int(k)) for h, k in zip(b["__html"], b["__key"].astype("Int64"), strict=True)]
            yield b[names].assign(text=texts, n_chars=[len(t) for t in texts], path=b["__path"])

    schema = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    out = rows.select(*names, "__html", "__path", F.col("__key")).mapInPandas(run, f"{schema}, text string, n_chars bigint, path string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept_names(keep, ("text", "n_chars", "path")), strict=True)], "text", "n_chars", "path")
