"""Main-text extraction by consensus host paths.

Each page is scanned into a light tree of its block elements. Menus, notices, adverts, forms and the like are set
aside by tag, role and class words. The page's best container is where the remaining unlinked text meets; its path of tags and classes, without digits and ids, is a vote. Spark counts the votes of each host, and every page
is read again at its host's winning path, or at its own best container where that path has no text.

Edge cases: null or empty html gives an empty text; a page whose url has no host votes with the others of that kind;
ties between paths go to the one that sorts first; repeated pages vote once each; broken markup is closed where a
browser would close it; a page of any length or depth takes linear time; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import byte_models, shared

# Element kinds and words of boilerplate.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas", "math", "video", "audio"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "option", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adbox", "adsbygoogle", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "paywall", "sidebar", "sidenav", "rail", "menu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related",
    "recommended", "recommendations", "widget", "toolbar", "pagination", "pager", "login", "signup", "signin", "search", "skip", "topbar", "alert", "disclaimer",
}
BLOCKS = set("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | DROPPED
CONTAINERS = {"body", "div", "section", "article", "main", "td", "html"}
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head", "option"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
VOID = {"hr", "br", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "adbox", "adsbygoogle", "sponsor", "sponsored"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
CONTENT = {"content", "post", "entry", "article", "story", "main"}
NEARLY_ALL, LEAST_WORDS = 0.9, 4
HOSTS_BROADCAST = 50_000

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""")
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HEADING = re.compile("h[1-6]$")
_QUOTED = re.compile(r"""([\w:-]+)\s*=\s*(?:"[^"]*"|'[^']*')""")
_HIDDEN = re.compile(r"""(?<![\w:-])hidden(?![\w:=-])|style\s*=.*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I | re.S)
_MODIFIER = re.compile(r"^(?:no|not|has|is|with|without|hide|show)[-_]|[-_](?:enabled|disabled|active|inactive)$|^elementor-widget(?![a-z])")


class Node:
    __slots__ = ("tag", "name", "parent", "dropped", "doubt", "chars", "linked", "real", "kids", "in_content", "first", "last")

    def __init__(self, tag: str, name: str, parent: Node | None, dropped: bool, doubt: set[str] | None = None):
        self.tag, self.name, self.parent, self.dropped, self.doubt = tag, name, parent, dropped, doubt
        self.chars, self.linked, self.real, self.kids = 0, 0, 0, []
        #: whether it is, or lies in, an element that announces content; where its elements begin and end in page order
        self.in_content = parent is not None and parent.in_content or tag in ("article", "main") or bool(CONTENT & set(re.split(r"[^a-z]+", name)))
        self.first = self.last = 0


def _attributes(text: str) -> tuple[list[str], str, str]:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if "=" in text else {}
    return found.get("class", "").lower().split(), found.get("id", "").lower(), found.get("role", "").lower()


def _words(name: str) -> set[str]:
    """The words of a class or id; none if it only says what an element has or lacks, or names a framework's box."""
    return set() if _MODIFIER.search(name) else set(re.split(r"[^a-z]+", name))


def _boiler(tag: str, attributes: str, parent: Node | None) -> tuple[str, bool, set[str]]:
    """The node's generalised name, whether its tag or role makes it boilerplate, and the class words that speak for it."""
    classes, ident, role = _attributes(attributes)
    plain = sorted({re.sub(r"\d+", "", c) for c in classes} - {""})
    name = ".".join([tag, *plain])
    if tag in ("html", "body"):
        return name, False, set()
    words = {w for c in [*classes, ident] for w in _words(c)}
    dropped, doubt = tag in DROPPED or role in ROLES, words & WORDS
    if (tag == "header" or "header" in words) and not dropped and not _HEADING.match(tag) and not (parent is not None and parent.in_content):
        if tag == "header":
            dropped = True
        else:
            doubt = doubt | {"header"}
    return name, dropped or _hidden(attributes), doubt


def _hidden(attributes: str) -> bool:
    """Whether a browser would not show the element."""
    return bool(attributes) and _HIDDEN.search(_QUOTED.sub(lambda m: m[0] if m[1].lower() == "style" else m[1], attributes)) is not None


def _aside(attributes: str) -> bool:
    """Whether an element within a line is an advert or not shown."""
    if not attributes:
        return False
    classes, ident, _ = _attributes(attributes)
    return _hidden(attributes) or any(_words(c) & ADVERTS for c in [*classes, ident])


def _settle(root: Node) -> None:
    """Drops the elements with boilerplate's class words, but not those that hold the page's main text.

    Such an element stays if it holds a main, the only h1 or all articles, or at least half of the unlinked text while
    no main or article is elsewhere alone; comments only with the main or the only h1, or where nothing else is marked.
    """
    order = _in_order(root)
    if not any(n.doubt for n in order):
        return
    sums = _totals(order, _unlinked)
    # marks by kind that begin before each place in page order: what a node holds is a difference of two
    held = {kind: [0] for kind in ("main", "article", "h1")}
    for n in order:
        marked = n.tag in held and not n.dropped and sums[n.first] > 0
        for kind, counts in held.items():
            counts.append(counts[-1] + (marked and n.tag == kind))
    mains, articles, titles = (counts[-1] for counts in held.values())

    def stays(node: Node) -> bool:
        main, article, title = (counts[node.last] - counts[node.first] for counts in held.values())
        if main or titles == 1 and title:
            return True
        if node.doubt & COMMENTS and main + article + title < mains + articles + titles:
            return False
        if article and article == mains + articles:
            return True
        return 2 * sums[node.first] >= sums[0] > 0 and (article > 0 or not mains + articles)

    for node in order:
        if node.parent is not None and node.parent.dropped or node.doubt and not node.dropped and not stays(node):
            node.dropped = True
    for node in order:
        if node.dropped:
            node.chars = node.linked = node.real = 0


def _closing(page: str, tag: str, at: int) -> int | None:
    """Where an element within a line ends whose content begins at `at`; nothing if it never does."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


def scan(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The root and the text blocks (block's node, text) in page order; boilerplate's text is left out."""
    root = Node("html", "html", None, False)
    stack, blocks, held = [root], [], []
    open_tags: dict[str, int] = {}
    links, linked, at, size = 0, 0, 0, len(page)
    lower, quotes, open_ended = None, True, set()

    def flush() -> None:
        nonlocal linked
        if held:
            node = stack[-1]
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text and not node.dropped:
                blocks.append((node, text))
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.real += 2 * linked < len(text) and (node.tag in ("h1", "p") or not _HEADING.match(node.tag) and (text[-1] in ".!?…:" or text.count(" ") >= LEAST_WORDS - 1))
            linked = 0

    def pop() -> None:
        flush()
        open_tags[stack.pop().tag] -= 1

    def pop_to(tags: set[str], fence: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in fence:
                return

    while at < size:
        lt = page.find("<", at)
        text = page[at:] if lt < 0 else page[at:lt]
        if text:
            held.append(text)
            linked += len(text) if links > 0 else 0
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) if quotes else None
        if m is None and page[lt + 1 : lt + 2].isalpha() | page.startswith("</", lt):
            end = page.find(">", lt)  # a quote that never closes: the tag ends at the next bracket, from here on
            quotes = False
            m = re.match(r"<(/?)([a-zA-Z]*)([^>]*)", page[lt : end if end >= 0 else size])
            at = end + 1 if end >= 0 else size
        elif m is None:
            held.append("<")
            at = lt + 1
            continue
        else:
            at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS and open_tags.get(tag, 0) > 0:
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            lower = lower or page.lower()
            end = -1 if m[3].endswith("/") and tag == "svg" else lower.find(f"</{tag}", at)
            if end < 0:
                at = at if m[3].endswith("/") or tag in ("video", "audio", "object", "svg", "math", "canvas") else size
            else:
                close = page.find(">", end)
                at = size if close < 0 else close + 1
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            links += 1
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag not in BLOCKS:
            if tag not in open_ended and not m[3].endswith("/") and _aside(m[3]):
                end = _closing(page, tag, at)
                if end is None:
                    open_ended.add(tag)
                else:
                    at = end
            continue
        flush()
        if tag == "html" or tag == "body" and open_tags.get("body", 0) > 0:
            continue
        if tag in CLOSES_P and open_tags.get("p", 0) > 0:
            pop_to({"p"}, {"td", "th", "table", "li", "div", "section", "article", "main"})
        if tag == "body" and open_tags.get("head", 0) > 0:
            pop_to({"head"}, set())
        if tag in IMPLIED:
            pop_to(*IMPLIED[tag])
        if _HEADING.match(tag) and _HEADING.match(stack[-1].tag):
            pop()
        if tag == "hr":
            continue
        name, own, doubt = _boiler(tag, m[3], stack[-1])
        parent = stack[-1]
        node = Node(tag, name, parent, parent.dropped or own, doubt)
        parent.kids.append(node)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    _settle(root)
    return root, [b for b in blocks if not b[0].dropped]


def path_of(node: Node) -> str:
    names = []
    while node is not None and node.tag != "html":
        names.append(node.name)
        node = node.parent
    return ">".join(reversed(names))


def _in_order(root: Node) -> list[Node]:
    """All nodes in page order; each learns its place, and where the nodes under it end."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.first = len(order)
        order.append(node)
        todo += reversed(node.kids)
    for node in reversed(order):
        node.last = node.kids[-1].last if node.kids else node.first + 1
    return order


def _totals(order: list[Node], own) -> list[int]:
    """The sum of own(node) under each node, by its place in page order."""
    sums = [own(n) for n in order]
    for node in reversed(order):
        if node.parent is not None:
            sums[node.parent.first] += sums[node.first]
    return sums


def _unlinked(node: Node) -> int:
    return node.chars - node.linked


def _below(node: Node, top: Node) -> bool:
    return top.first <= node.first < top.last


def best_container(root: Node) -> Node | None:
    """Where all unlinked text meets.

    The only main element, if it holds most of the text and every h1, or else the page, is the scope. Its article is taken if it holds
    nearly all of the scope's text, or if it is the only one and holds both the h1 and most of the text. Otherwise the
    walk goes down from the scope as long as what it leaves behind has no text block: no h1, and nothing that ends
    like a sentence or has four words or more (headings and links aside).
    """
    order = _in_order(root)
    sums = _totals(order, _unlinked)
    if not sums[0]:
        return None
    articles, mains, titles = [], [], []
    for node in order:
        if not node.dropped and sums[node.first]:
            kind = {"article": articles, "main": mains, "h1": titles}.get(node.tag)
            if kind is not None and not (node.tag == "article" and articles and _below(node, articles[-1])):
                kind.append(node)
    scope = mains[0] if len(mains) == 1 else root
    if 2 * sums[scope.first] <= sums[0] or any(not _below(t, scope) for t in titles):
        scope = root
    inside = [a for a in articles if _below(a, scope)]
    if inside:
        top = max(inside, key=lambda n: sums[n.first])
        titled = len(articles) == 1 and len(titles) == 1 and _below(titles[0], top) and 2 * sums[top.first] > sums[scope.first]
        if titled or sums[top.first] >= NEARLY_ALL * sums[scope.first] and not any(t for t in titles if _below(t, scope) and not _below(t, top)):
            return top
    if scope is not root:
        return scope
    real = _totals(order, lambda n: n.real)
    weight = real if real[0] else sums
    node = root
    while True:
        inner = [k for k in node.kids if k.tag in CONTAINERS and not k.dropped]
        top = max(inner, key=lambda k: weight[k.first], default=None)
        if top is None or weight[top.first] < weight[node.first]:
            return node
        node = top


def _at_path(order: list[Node], path: str) -> list[bool]:
    """For each node whether it lies at or under a node of that path: names are compared along the tree, once a node."""
    names = path.split(">")
    met, inside = [0] * len(order), [False] * len(order)  # how many names a node's own path agrees with; -1 once it does not
    for i, node in enumerate(order):
        if node.parent is None:
            continue
        above = node.parent.first
        so_far = met[above]
        met[i] = so_far + 1 if 0 <= so_far < len(names) and node.name == names[so_far] else -1
        inside[i] = inside[above] or met[i] == len(names)
    return inside


def text_at(root: Node, blocks: list[tuple[Node, str]], path: str | None) -> str:
    """The blocks under the nodes of that path, or under the page's own best container.

    The path is left where it has but a part of the page's text (no h1, and less than half of what the page's own
    container has), as with a teaser in the place that other pages of the host have their article in.
    """
    own = best_container(root)
    if own is None:
        return ""
    mine = [(n, t) for n, t in blocks if _below(n, own)]
    if path is not None:
        inside = _at_path(_in_order(root), path)
        kept = [(n, t) for n, t in blocks if inside[n.first]]
        size = lambda found: sum(len(t) for _, t in found)
        if kept and (any(n.tag == "h1" for n, _ in kept) or 2 * size(kept) >= size(mine)):
            mine = kept
    return "\n".join(t for _, t in mine)


def _pages(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for piece in byte_models.slices(batch):
        yield piece, [x or "" for x in piece.column(column).to_pylist()]


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many pages of the host have their best container there."""

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in _pages(batch, 1):
                found = [best_container(scan(t)[0]) for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([None if n is None else path_of(n) for n in found], pa.string())], ["host", "path"])

    picked = pages.select("host", "html").mapInArrow(run, "host string, path string")
    return picked.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the most voted path of each host."""
    # the smallest struct: most votes first, then the path that sorts first
    best = F.min(F.struct((-F.col("votes")).alias("v"), F.col("path").alias("path")))
    return votes.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    winners = shared.staged(winning_paths(host_votes(rows)), "winners")
    met = rows.join(shared.sized(winners, HOSTS_BROADCAST), "host", "left").select("page_id", "url", "html", "path")
    kind = shared.kind_of(pages, "page_id")

    @shared.trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in _pages(batch, 2):
                out = [text_at(*scan(t), p) for t, p in zip(texts, piece.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
