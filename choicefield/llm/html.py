"""Main text of web pages by composite text density.

Every node of a page's element tree gets its number of characters and tags and the part of both that lies in links. Its
composite density weighs characters per tag by how much of the text is linked, compared with the ratio of the whole body; scripts,
styles, forms and other things that are never text are not counted. The sum of the densities of a node's children is largest for
the element that holds the article. The threshold is the smallest density on the path from that node to the body: parts of the
chosen subtree below it are dropped if they look like boilerplate by name or are mostly links.

Elements are left out by kind, role or name only after the whole tree was counted: one that holds most of the page's unlinked
text wraps the article and stays (a form around a page, "content-sidebar-wrap"); the controls of a form never count.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, picked, text_slices

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                    r"|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
                   "tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body html caption td th tr tbody thead tfoot option optgroup legend".split())
_CLOSERS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "option": ({"option"}, {"select", "optgroup"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
            "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tfoot", "tr", "td", "th"}, {"table"})}
_NEVER = frozenset("script style textarea title noscript iframe template xmp noframes head button select input svg canvas object embed "
                   "audio video map math datalist".split())
_SELDOM = frozenset("form dialog nav aside footer menu".split())
_STATE = re.compile(r"(?<!\S)(?:has|no|with|without|is|not)[_-]\S*", re.I)  # classes that tell what a wrapper holds or lacks
_OTHERS = re.compile(r"(?:^|[\s_-])(?:cookie\w*|consent|gdpr|popup|modal|overlay|comment\w*|disqus|respond|reply|replies|legal|disclaimer)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|outbrain|taboola|menu\w*|nav|navbar|navigation|breadcrumb\w*"
                    r"|sidebar\w*|side|widget\w*|footer\w*|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay"
                    r"|newsletter|subscribe\w*|signup|login|share|sharing|social\w*|related\w*|recommend\w*|comment\w*|disqus|respond|reply|replies"
                    r"|pagination|pager|copyright|legal|disclaimer|skip|search\w*|form)(?:$|[\s_-])", re.I)
_HEADERS = re.compile(r"(?:^|[\s_-])(?:header|head|top)(?:$|[\s_-])", re.I)
_ARTICLE = frozenset("article main".split())


@dataclass(slots=True)
class Node:
    name: str
    dropped: int
    parent: Node | None
    items: list = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    below: float = 0.0


# Why an element is left out: never text or hidden; text of its own that may be longer than the article; boilerplate unless it wraps the page.
_HARD, _OWN, _SOFT = 1, 2, 3


def _dropped(name: str, attrs: str, in_article: bool) -> int:
    """Why an element is boilerplate by its kind, role or name, 0 if it is not. Headers count only outside an article."""
    if name in _NEVER:
        return _HARD
    why = _SOFT if name in _SELDOM or name == "header" and not in_article else 0
    if not attrs or name in ("html", "body") or name in _ARTICLE and not re.search("comment|repl", attrs, re.I):
        return why
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _HARD
        if key == "role" and value.lower() in _ROLES:
            why = why or _SOFT
        if key in ("class", "id"):
            value = _STATE.sub(" ", value)
            if _OTHERS.search(value):
                why = _OWN
            elif _NAMES.search(value) or _HEADERS.search(value) and not in_article and not re.fullmatch("h[1-6]", name):
                why = why or _SOFT
    return why


def _length(text: str) -> int:
    return len(_SPACE.sub(" ", entities.unescape(text)).strip())


def keep_wrappers(root: Node) -> None:
    """Elements that would be left out but hold most of the page's unlinked text stay, unless an article element outside has text.

    Comments, consent dialogs and the like do not count as the page's text while it has other text, and never stay then."""
    order, todo = [], [(root, False, False)]
    while todo:
        node, linked, article = todo.pop()
        if node.dropped != _HARD:
            linked, article = linked or node.name == "a", article or node.name in _ARTICLE and not node.dropped
            order.append((node, linked, article))
            todo += [(c, linked, article) for c in node.items if isinstance(c, Node)]
    if not any(n.dropped for n, _, _ in order):
        return
    sizes = [0 if linked else sum(_length(t) for t in n.items if isinstance(t, str)) for n, linked, _ in order]
    for others in (_OWN, _HARD):  # without the text of others; if that leaves nothing, with it
        free, shown = {}, {}
        for (node, _, article), own in zip(reversed(order), reversed(sizes)):
            inner = [c for c in node.items if isinstance(c, Node)]
            free[id(node)] = 0 if node.dropped == others else own + sum(free.get(id(c), 0) for c in inner)
            shown[id(node)] = 0 if node.dropped else (own if article else 0) + sum(shown.get(id(c), 0) for c in inner)
        if free[id(root)]:
            break
    for node, _, _ in order:
        if node.dropped and node.dropped != others and 2 * free[id(node)] > free[id(root)] and not shown[id(root)]:
            node.dropped = 0


def parsed(source: str) -> Node:
    """The element tree; unclosed and misnested elements are closed where a browser would close them."""
    root = now = Node("html", 0, None)
    open_ = ["html"]
    places: dict[str, list[int]] = {}  # where elements of a name are open
    at = 0

    def last(names: set[str] | frozenset[str] | tuple) -> int:
        return max([places[n][-1] for n in names if places.get(n)], default=0)

    def close_to(names: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of these names and all in it, unless one of ``scope`` is open inside it."""
        nonlocal now
        i = last(names)
        if i and i >= last(scope):
            for _ in range(len(open_) - i):
                places[open_.pop()].pop()
                now = now.parent

    for m in iter(lambda: _TOKEN.search(source, at), None):
        if m.start() > at:
            now.items.append(source[at:m.start()])
        at = m.end() if m.end() > m.start() else m.end() + 1
        if m["cdata"]:
            now.items.append(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                now.items.append(" ")
            elif name not in ("html", "body"):
                close_to({name}, frozenset() if name in _BLOCK else frozenset(("td", "th", "table", "article", "main", "section")))
            continue
        if name in ("html", "body"):
            continue
        if name in _CLOSES_P:
            close_to({"p"}, frozenset(("button", "table", "td", "th", "article", "section", "div", "li", "blockquote")))
        if name in _CLOSERS:
            close_to(*_CLOSERS[name])
        if name in _VOID:
            now.items.append(Node(name, _HARD, now) if name != "br" else " ")
            continue
        node = Node(name, _dropped(name, m["attrs"], last(_ARTICLE) > 0), now)
        now.items.append(node)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif not m["attrs"].rstrip().endswith("/") or name not in ("svg", "path"):
            now = node
            places.setdefault(name, []).append(len(open_))
            open_.append(name)
    if at < len(source):
        now.items.append(source[at:])
    return root


def walk(root: Node) -> list[Node]:
    """Kept nodes, parents before children; not recursive, as trees can be deep."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            order.append(node)
            todo += [c for c in reversed(node.items) if isinstance(c, Node)]
    return order


def measure(root: Node) -> list[Node]:
    order = walk(root)
    for node in reversed(order):
        node.chars += sum(_length(t) for t in node.items if isinstance(t, str))
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    whole = root
    ratio = whole.link_chars / max(whole.chars, 1)
    for node in order:
        if not node.chars:
            continue
        rest = max(node.chars - node.link_chars, 1)
        base = math.log(node.chars * node.link_chars / rest + ratio * node.chars + math.e)
        linked = node.chars / max(node.link_chars, 1) * node.tags / max(node.link_tags, 1)
        per_tag = node.chars / max(node.tags, 1)
        node.density = per_tag * max(math.log(max(linked, 1.0) + 1) / math.log(base + 1), 0.0)
    for node in order:
        if node.parent is not None:
            node.parent.below += node.density
    return order


def blocks(top: Node, threshold: float) -> list[str]:
    """Texts of the blocks of a subtree in page order, white space folded; linked parts under the threshold are left out."""
    out: list[list[str]] = [[]]
    todo: list = [top]
    while todo:
        item = todo.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(item)
        elif not item.dropped:
            if item is not top and item.density < threshold and item.chars and item.link_chars > 0.5 * item.chars and item.name in _BLOCK:
                out.append([])
                continue
            edge = [None] if item.name in _BLOCK else []
            todo += edge + item.items[::-1] + edge
        elif item.name in _BLOCK:
            out.append([])
    texts = (_SPACE.sub(" ", "".join(map(entities.unescape, b))).strip() for b in out)
    return [t for t in texts if t]


def _wraps(outer: Node, inner: Node) -> bool:
    """Whether an element other than the body adds little but a heading or a line to the densest one."""
    return outer.parent is not None and outer.chars - outer.link_chars <= 1.3 * (inner.chars - inner.link_chars)


def main_text(source: str) -> str:
    """The blocks of the densest subtree, joined by newlines; empty if the page has no text."""
    root = parsed(source)
    keep_wrappers(root)
    order = [n for n in measure(root) if n.chars]
    top = max(order, key=lambda n: n.below, default=root)
    while top.parent is not None and (top.name not in _BLOCK or top.name in ("p", "li") or _wraps(top.parent, top)):
        top = top.parent
    path, node = [], top
    while node is not None:
        path.append(node.density)
        node = node.parent
    return "\n".join(blocks(top, min(path, default=0.0)))


def _main_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for part in text_slices(batch, "html"):
        texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
        yield {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; repeated rows each give a row, other columns are not read.

    ``text`` is the main text, its blocks joined by a newline, white space inside a block one space; empty for a null or empty page
    and one without text. ``n_chars`` counts its code points. An empty table gives no rows.
    """
    rows = picked(df, page_id=page_id, url=url, html=html)
    return arrow_map(rows, _main_rows, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
