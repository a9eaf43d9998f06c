"""Main text of web pages by consensus host paths.

Names of classes and ids are evidence, not a verdict: an element that they mark goes only if enough text is left without it, so a
page with visible text never ends empty. Each page scores its containers and votes for the path, of tags and generalised classes, to the best of them. Spark counts the
votes by host, and each page is then extracted again from the containers at its host's winning path.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import cut, map_arrow

BROADCAST_HOSTS = 50_000
#: Paths of a host that come with its pages, most votes first. A page that has none of them is joined with all votes of its host.
PATHS = 16
#: Choices of such pages that are broadcast; and the parts in which a host's paths are ranked first.
BROADCAST_CHOICES = 20_000
SALTS = 32

#: Elements by what they mean for the extraction.
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object svg canvas audio video dialog menu label input".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body div section article main td center".split())
#: Open elements that an element ends, and those that bound the search for them.
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "html": ((), ()), "body": ((), ())}
PARAGRAPH = (("p",), ())
WALLS = CONTAINERS | DROPPED
#: Words of class, id and role that tell of what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail complementary footer foot contentinfo masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending comment comments commentlist respond reply replies discussion disqus widget widgets pagination pager toolbar search skip copyright legal disclaimer".split())
HEADS = frozenset("header heading head".split())
OWN_HEADS = frozenset("post entry article story title main content page".split())
#: Words beside which a mark keeps its full weight, and marks that weigh in an article element too.
FILLER = frozenset("block box container wrapper wrap inner outer area section list item items bar button buttons link links icon icons site top bottom left right primary secondary global user post posts article entry panel unit slot zone holder module".split())
READERS = frozenset("comment comments reply replies".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s/]|$)", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NUMBER = re.compile(r"[0-9]+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
BOOST = 3.0
SHARE = 0.6
#: A list or division is a menu if so much of its text is in links, and it has so many; but not if its container has so many times its text before it.
LINKED, LINKS, BEFORE = 0.8, 3, 3
#: An element of a marked name goes if so many letters, or this share of its own, are left without it.
ENOUGH, ENOUGH_SHARE = 140, 0.25
WEAK, STRONG = 1, 2


@dataclass(eq=False)
class Node:
    """An element; key is a hash of its path, chained from its parent's, so that deep trees stay small."""

    tag: str
    step: str
    key: bytes
    start: int
    depth: int = 0
    inside: bool = False
    dropped: bool = False
    hidden: bool = False
    mark: int = 0
    up: Node | None = None
    kids: list[Node] = field(default_factory=list)
    end: int = 0
    own: float = 0.0
    alone: float = 0.0
    size: int = 0
    linked: int = 0
    links: int = 0


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def unseen(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is none of the page's text, whatever else the page has."""
    return tag in DROPPED or bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower())


@lru_cache(maxsize=1 << 14)
def told(name: str) -> tuple[int, bool]:
    """What one class, id or role tells: STRONG if the whole name, or all of its pieces but fillers, are marks, WEAK if some piece is; and whether readers' words are meant."""
    pieces = {w.lower() for w in PIECES.findall(name)}
    heads = pieces & HEADS if not pieces & OWN_HEADS else frozenset()
    hits = pieces & MARKS | heads
    if name.lower() in MARKS or hits and pieces <= MARKS | HEADS | FILLER:
        return STRONG, bool(pieces & READERS)
    return (WEAK if hits else 0), bool(pieces & READERS)


def marked(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """How strongly an element's names tell that it is not part of the article; inside: it stands in an article or main element."""
    if tag == "header":
        return 0 if inside else STRONG
    if not attrs or tag in ("html", "body", "main"):
        return 0
    level, readers = 0, False
    for k in ("class", "id", "role"):
        for name in attrs.get(k, "").split():
            weight, own = told(name)
            level, readers = max(level, weight), readers or own
    return min(level, WEAK) if tag == "article" and not readers else level


def general(tag: str, attrs: dict[str, str]) -> str:
    """Tag and classes, in order of name, numbers in them generalised."""
    names = sorted({NUMBER.sub("#", c).replace("/", "|") for c in attrs.get("class", "").split()})
    return ".".join([tag.replace("/", "|"), *names])


@lru_cache(maxsize=1 << 14)
def chained(key: bytes, step: str) -> bytes:
    return hashlib.blake2b(key + step.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def path_of(node: Node) -> str:
    """The path of an element, from the root."""
    steps = []
    while node.up is not None:
        steps.append(node.step)
        node = node.up
    return "/".join(["", *reversed(steps)])


@lru_cache(maxsize=4096)
def key_of(path: str) -> bytes:
    """The key of an element at a path."""
    key = b""
    for step in path.split("/")[1:]:
        key = chained(key, step)
    return key


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool]], list[int]]:
    """The tree of block elements, the stretches of text with their element and whether a block edge comes before, and the letters outside links before each."""
    root = Node("", "", b"", 0)
    at, texts, before, done, edge, anchor, n = root, [], [0], 0, True, 0, len(page)
    # Depths of the open elements of each tag, and of those that bound searches: what is open is found without climbing.
    chain, opened, walls = [root], defaultdict(list), []
    paragraphs = opened["p"]
    m = TOKEN.search(page)

    def close(depth: int) -> None:
        nonlocal at
        while len(chain) > depth:
            last = chain.pop()
            last.end = len(texts)
            opened[last.tag].pop()
            if last.tag in WALLS:
                walls.pop()
        at = chain[-1]

    def ended(tag: str) -> int:
        """Depth of the innermost open element that the tag ends, 0 if none is in reach."""
        ends, bounds = CLOSES.get(tag, PARAGRAPH)
        last = lambda tags: max((opened[t][-1] for t in tags if opened[t]), default=0)
        depth = max(last(ends), last(("p",)) if tag in BLOCKS else 0)
        edge = max(last(bounds), walls[-1] if walls else 0)
        return depth if depth > edge or depth == edge and chain[depth].tag in ends else 0

    def text(a: int, b: int) -> None:
        nonlocal edge
        if b > a:
            part = page[a:b]
            if "&" in part:
                part = entities.unescape(part)
            texts.append((at, part, edge))
            edge = False
            k = len(part.strip())
            at.size += k
            at.linked += k if anchor else 0
            own = 0 if anchor or at.hidden else k
            at.own += own
            before.append(before[-1] + own)

    while m:
        text(done, m.start())
        done = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            pass
        elif tag == "a":
            anchor = 0 if m[1] else 1
            at.links += not m[1]
        elif tag in RAW and not m[1]:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, done)
                done = stop.start() if stop else n
        elif tag in BLOCKS or tag in DROPPED:
            edge, anchor = True, 0
            if m[1]:
                if opened[tag]:
                    close(opened[tag][-1])
            elif tag not in VOID and not (m[3].endswith("/") and tag in DROPPED):
                while (paragraphs or tag in CLOSES) and (depth := ended(tag)):
                    close(depth)
                attrs = attributes(m[3]) if m[3] else {}
                step = general(tag, attrs) if attrs else tag
                node = Node(tag, step, chained(at.key, step), len(texts), len(chain), at.inside or tag in ("article", "main"), up=at)
                node.dropped = node.hidden = at.hidden or unseen(tag, attrs)
                node.mark = 0 if node.hidden else marked(tag, attrs, at.inside)
                at.kids.append(node)
                opened[tag].append(node.depth)
                if tag in WALLS:
                    walls.append(node.depth)
                chain.append(node)
                at = node
        elif tag in VOID:
            edge = edge or tag in ("br", "hr")
        m = TOKEN.search(page, done)
    text(done, n)
    close(1)
    root.end = len(texts)
    return root, texts, before


def under(node: Node) -> list[Node]:
    """A node and all below it, each before its own; without recursion, as pages may nest deeply."""
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += x.kids
    return order


def prune(scope: Node) -> None:
    """Drops the marked elements of a scope that leave enough text; in those that stay, the same is asked again.

    A strong mark goes if a paragraph or a quarter of its own text is left, or an article or main element has text; a weak one only if
    more text is left than it holds.
    """
    todo = [scope]
    while todo:
        scope = todo.pop()
        marks, stack, kept = [], list(scope.kids), False
        while stack:
            x = stack.pop()
            if x.mark and not x.hidden:
                marks.append(x)
            else:
                kept |= x.tag in ("article", "main") and x.own > 0
                stack += x.kids
        rest = scope.own - sum(x.own for x in marks)
        for x in marks:
            if rest > x.own if x.mark == WEAK else rest >= min(ENOUGH, ENOUGH_SHARE * x.own) and rest or kept and rest:
                x.dropped = True
            else:
                todo.append(x)


def weigh(root: Node, before: list[int]) -> None:
    """Sums text, linked text and links over subtrees, and drops what is not the article: marked elements and menus."""
    order = under(root)

    def add_up() -> None:
        for x in reversed(order):
            x.own = 0 if x.dropped else x.alone + sum(k.own for k in x.kids)

    for x in order:
        x.alone = x.own
    for x in reversed(order):
        for k in x.kids:
            x.size, x.linked, x.links = x.size + k.size, x.linked + k.linked, x.links + k.links
    add_up()
    prune(root)
    around: dict[Node, Node] = {}
    for x in order:
        around[x] = x.up if x.up is None or x.up.tag in CONTAINERS and not x.up.inside or x.up.tag in ("article", "main") else around[x.up]
        if x.tag in ("ul", "ol", "div", "section") and x.links >= LINKS and x.linked >= LINKED * max(1, x.size):
            within = around[x] or root
            x.dropped |= before[x.start] - before[within.start] < BEFORE * x.linked
        for k in x.kids:
            k.dropped |= x.dropped
    add_up()


def restore(root: Node) -> None:
    """Brings back all that can be seen, for pages of which nothing else is left."""
    for x in under(root):
        x.dropped = x.hidden


def best(root: Node) -> Node:
    """From the top down, the container that holds most of what its parent holds."""
    at = root
    while True:
        kids, stack = [], list(at.kids)
        while stack:
            k = stack.pop()
            if k.tag in CONTAINERS:
                kids.append(k)
            else:
                stack += k.kids
        worth = lambda k: k.own * (BOOST if k.tag in ("article", "main") else 1)
        top = max(kids, key=lambda k: (worth(k), -k.start), default=None)
        if top is None or not top.own or worth(top) < SHARE * at.own:
            return at
        at = top


def title(nodes: list[Node], root: Node, before: list[int]) -> list[Node]:
    """The last first-level heading before the nodes, if they have none and hardly any text comes between; it stands beside them or beside what holds them."""
    first, last, held = nodes[0], None, set()
    starts = [n.start for n in nodes]  # of one path, so none holds another
    while first is not None:
        held.add(first)
        first = first.up
    for x in under(root):
        if x.tag == "h1" and x.own and not x.dropped:
            i = bisect_right(starts, x.start) - 1
            if i >= 0 and x.start < nodes[i].end:
                return []
            if x.end <= nodes[0].start and x.up in held and (last is None or x.start > last.start):
                last = x
    return [last] if last and before[nodes[0].start] - before[last.end] <= ENOUGH else []


def gather(nodes: list[Node], texts: list[tuple[Node, str, bool]]) -> str:
    out = []
    for node in nodes:
        out.append(" ")
        for at, part, edge in texts[node.start : node.end]:
            if not at.dropped:
                out += [" ", part] if edge else [part]
            elif edge:
                out.append(" ")
    return " ".join("".join(out).split())


def weighed(page: str) -> tuple[Node, list[tuple[Node, str, bool]], list[int]]:
    root, texts, before = parse(page)
    weigh(root, before)
    return root, texts, before


def vote(page: str | None) -> str | None:
    """Path of the page's best container; None for a page without text of its own."""
    root = weighed(page)[0] if page else None
    return path_of(best(root)) if root and root.own else None


def at_paths(root: Node) -> dict[bytes, list[Node]]:
    """The elements with text of a weighed page that are part of the article, by the key of their path."""
    by: dict[bytes, list[Node]] = {}
    stack = [root]
    while stack:
        x = stack.pop()
        if not x.dropped:
            if x.own:
                by.setdefault(x.key, []).append(x)
            stack += x.kids
    return by


def missed(page: str | None, paths: list[str]) -> list[str]:
    """The keys of all paths of a page with text that has none of the given ones; else nothing."""
    if not page:
        return []
    root = weighed(page)[0]
    by = at_paths(root) if root.own else {}
    return [] if any(key_of(p) in by for p in paths) else [k.hex() for k in by]


def extract(page: str | None, paths: list[str] | None = None, rest: bool = False) -> str | None:
    """Text at the first of the paths that the page has with any text, else of the page's own best container; rest: else None if the page has text.

    A page that has nothing but menus or marked elements gives all of its visible text.
    """
    if not page:
        return ""
    root, texts, before = weighed(page)
    if not root.own:
        restore(root)
        return gather([root], texts)
    by = at_paths(root) if paths else {}
    nodes = next((by[key] for key in map(key_of, paths or ()) if key in by), None)
    if nodes is None and rest:
        return None
    nodes = sorted(nodes or [best(root)], key=lambda x: x.start)
    return gather(title(nodes, root, before) + nodes, texts)


def host(url: Column) -> Column:
    """Lower-case host of a URL; an empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, key, path, n): the votes of each host, all of them, by path and its key. Hot hosts are counted before the shuffle."""

    def run(c: dict[str, list]) -> dict[str, list]:
        paths = [vote(p) for p in c["html"]]
        return {"host": c["host"], "key": [None if p is None else key_of(p).hex() for p in paths], "path": paths}

    votes = map_arrow(pages.select(host(F.col("url")).alias("host"), "html"), run, "host string, key string, path string")
    return votes.where("path IS NOT NULL").groupBy("host", "key").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def host_paths(votes: DataFrame, most: int = PATHS) -> DataFrame:
    """(host, paths, more): the paths of each host by votes, so many of them, and whether it has more. Parts of a host are ranked first."""
    order = [F.desc("n"), F.desc(F.length("path")), F.asc("path")]
    salted = votes.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("host", "salt").orderBy(*order))
    # One more than wanted tells whether a host has more.
    few = salted.withColumn("part", part).where(F.col("part") <= most + 1)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(*order))).where(F.col("rank") <= most + 1)
    listed = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "path"))))
    return top.groupBy("host").agg(F.transform(listed, lambda x: x["path"]).alias("paths"), (F.max("rank") > most).alias("more"))


def choices(pages: DataFrame, votes: DataFrame) -> DataFrame:
    """(c_host, c_key, path) of the contents that have none of their host's listed paths: of their paths the one with most votes.

    pages: (key, html, host, paths) of hosts with more paths than are listed. Equal contents of a host are one.
    """
    found = map_arrow(pages, lambda c: {"host": c["host"], "key": c["key"], "at": [missed(p, w) for p, w in zip(c["html"], c["paths"], strict=True)]}, "host string, key string, at array<string>")
    at = found.where(F.size("at") > 0).select("host", F.col("key").alias("content"), F.explode("at").alias("key")).distinct()
    ranked = F.min(F.struct((-F.col("n")).alias("n"), (-F.length("path")).alias("size"), "path"))
    return at.join(votes, ["host", "key"]).groupBy(F.col("host").alias("c_host"), F.col("content").alias("c_key")).agg(ranked["path"].alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page. Null html gives an empty text; repeated rows, null page_id and null urls stay; an
    empty table gives an empty one; other columns play no part.

    A page whose text is all in menus or marked elements gives all of it; only what cannot be seen or is no text gives an empty one.
    Pages are read in time in proportion to their length, however deep they nest or broken they are. Paths with equal votes go by
    length, then by name.

    Pages without a host share one. The hosts' paths are broadcast if there are few hosts, else joined by shuffle. The few pages that
    have none of the listed paths of a host with more of them are extracted apart, at the path that a join with all votes finds.
    """
    votes = cut(host_votes(pages))
    paths = cut(host_paths(votes, PATHS)).withColumnRenamed("host", "p_host")
    small = F.broadcast(paths) if paths.count() <= BROADCAST_HOSTS else paths
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(small, F.col("host") == F.col("p_host"), "left")

    def run(c: dict[str, list]) -> dict[str, list]:
        texts = [extract(p, w, bool(m)) for p, w, m in zip(c["html"], c["paths"], c["more"], strict=True)]
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [None if t is None else len(t) for t in texts]}

    schema = "page_id long, url string, text string, n_chars long"
    out = map_arrow(rows.select("page_id", "url", "html", "paths", "more"), run, schema)
    if paths.where("more").isEmpty():
        return out
    wide = rows.where("more").withColumn("key", F.sha2("html", 256))
    chosen = cut(choices(wide.select("key", "html", "host", "paths"), votes))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_CHOICES else chosen
    late = wide.join(chosen, (F.col("host") == F.col("c_host")) & (F.col("key") == F.col("c_key")))
    late = late.select("page_id", "url", "html", F.array("path").alias("paths"), F.lit(False).alias("more"))
    return out.where("text IS NOT NULL").unionByName(map_arrow(late, run, schema))


def op4(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
