"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML, and words by which pages mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed".split())
DROPPED = frozenset("head script style title textarea iframe noscript xmp noembed nav header footer aside form button select input template svg canvas object dialog menu audio video fieldset datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre td li dd blockquote div section article main h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
NOISE_WORDS = frozenset("ad ads adv adbox adslot nav navbar menu menus crumbs header masthead topbar sidebar rail aside notice notices alert consent gdpr banner popup modal overlay newsletter subscribe subscription signup login share sharing social related widget widgets pagination pager toolbar outbrain taboola disqus replies respond promo promos promotion promotions skip hidden".split())
NOISE_STARTS = ("advert", "sponsor", "sidebar", "footer", "cookie", "comment", "breadcrumb", "navigation", "recommend")
#: Words that go with those in the name of a box. With another word beside them, as in "related-work", the name is of a subject.
BOX_WORDS = frozenset("area articles bar block blocks body box bottom bucket buttons btn btns card cards col column container content count cta div el feed footer form group header holder icon icons inner in item items label left links link list main module modules nav news outer panel pane posts post region right row rows section sections slot slots stories story strip tab tabs text title tools top unit units up wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
KEPT_TAGS = frozenset("html body article main".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6".split())
HEADS = frozenset("article main h1".split())
#: The head of reader comments, as a whole block.
_COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|latest|all|les|los) )?(?:comments?|responses?|replies|kommentare?|leserkommentare|antworten|commentaires?|réponses|comentarios?|respuestas?)(?: \(?\d+\)?)?:?", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.S)
_MARK = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


class Node:
    """An element: its children are nodes and strings in page order."""

    __slots__ = ("children", "named", "noise", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, named: bool = False):
        self.tag, self.parent, self.noise, self.named, self.score = tag, parent, noise, named, 0.0
        self.children: list[Node | str] = []


def _names_noise(token: str, tag: str) -> bool:
    """Whether a class or id names what is not the article. A paragraph's or heading's must be that word alone,
    as in "ad"; "ad-free" and "lead-share" there tell of the text. Elsewhere its other words must be those of a box:
    "related-posts" is one, "related-work" a subject. What is free of something has none of it."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    if (tag in TEXT_TAGS and len(words) > 1) or "free" in words:
        return False
    noise = [w in NOISE_WORDS or w.startswith(NOISE_STARTS) for w in words]
    strong = any(w.startswith(NOISE_STARTS) for w in words)
    return any(noise) and (strong or all(n or w in BOX_WORDS or len(w) < 3 for n, w in zip(noise, words, strict=True)))


def _is_noise(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is no part of an article, and whether only its classes or id tell so. A header
    ``inside`` an article is the article's own; a heading's id is a mark to link to."""
    if tag in DROPPED and not (tag == "header" and inside):
        return True, False
    if not attributes or tag in KEPT_TAGS:
        return False, False
    named = False
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "id" and tag in HEADINGS:
            continue
        if name in ("class", "id"):
            named = named or any(_names_noise(token, tag) for token in value.split())
        elif (name == "role" and value in NOISE_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True, False
    return named, named


class _Open:
    """The open elements, outermost first, with the places of each name, so that no tag walks the whole stack."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def close(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the outermost open one of ``tags`` that is inside the innermost of ``within``."""
        floor = max((self.places[t][-1] for t in within if self.places[t]), default=0)
        inside = [self.places[t][k] for t in tags if (k := bisect_right(self.places[t], floor)) < len(self.places[t])]
        if inside:
            self.cut(min(inside))


def parse(html: str) -> Node:
    """The element tree. End tags that are missing or misplaced close what they must; cut pages end open."""
    root = Node("html", None)
    held, position = _Open(root), 0
    while m := _TOKEN.search(html, position):
        at = held.nodes[-1]
        if m.start() > position:
            at.children.append(html[position : m.start()])
        position = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if held.places[tag]:
                held.cut(held.places[tag][-1])
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            held.close(("p",), ("table", "td", "th", "li", "button"))
        if tag in CLOSES:
            what, within = CLOSES[tag]
            held.close(tuple(what.split()), tuple(within.split()))
        at = held.nodes[-1]
        attributes = m[3] or m[6] or ""
        node = Node(tag, at, *_is_noise(tag, attributes, bool(held.places["article"] or held.places["main"])))
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(html, position)
            position = end.end() if end else len(html)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            held.push(node)
    if position < len(html):
        held.nodes[-1].children.append(html[position:])
    return root


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.noise)


def _lengths(root: Node) -> dict[int, tuple[int, int, int]]:
    """For each kept node: characters and commas of its text, and characters inside links."""
    out: dict[int, tuple[int, int, int]] = {}
    for n in reversed(list(_walk(root))):
        size = commas = links = 0
        for c in n.children:
            if isinstance(c, str):
                size += len(" ".join(c.split()))
                commas += c.count(",") + c.count("，") + c.count("、")
            elif not c.noise:
                a, b, d = out[id(c)]
                size, commas, links = size + a, commas + b, links + d
        out[id(n)] = (size, commas, size if n.tag == "a" else links)
    return out


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of blocks in page order: references decoded, white space turned into one space."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(parts)).split()):
            out.append(text)
        parts.clear()

    stack: list = [*reversed(nodes)]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            parts.append(n)
        elif not n.noise:
            if n.tag == "br":
                parts.append(" ")
            elif n.tag in INLINE:
                stack.extend(reversed(n.children))
            else:
                flush()
                stack.append(None)
                stack.extend(reversed(n.children))
    flush()
    return out


def _lists_of_text(best: Node, density) -> set[int]:
    """The lists that stand right after a paragraph or heading of their container and before a further paragraph of it: the text's own."""
    out: set[int] = set()
    text = lambda c: c.tag in TEXT_TAGS and density(c) < 0.25
    for n in _walk(best):
        around = [c for c in n.children if isinstance(c, Node) and not c.noise and c.tag not in INLINE and c.tag not in VOID]
        last = max((i for i, c in enumerate(around) if c.tag == "p" and text(c)), default=-1)
        out.update(id(c) for i, c in enumerate(around) if c.tag in ("ul", "ol") and 0 < i < last and text(around[i - 1]))
    return out


def main_text(html: str | None) -> str:
    """The article's text: blocks joined by newlines; empty if there is none.

    Paragraphs pass 1 + their commas + up to 3 points for length to their parent, half to the
    grandparent and a third to the next; scores are discounted by link density. The best container is
    taken (widened to an enclosing article or main element), with siblings that score well or read
    like text; lists that are mostly links are menus and go.
    """
    root = parse(html or "")
    return _article(root) or _article(_unwrapped(root))


def _unwrapped(root: Node) -> Node:
    """The tree with elements that classes or ids mark as noise counted where they hold the article's element
    or headline: a page's outermost element may be named after its sidebar."""
    stack, seen = [root], set()
    while stack:
        n = stack.pop()
        n.score = 0.0
        up = n if n.tag in HEADS else None
        while up is not None and id(up) not in seen:
            seen.add(id(up))
            up.noise &= not up.named
            up = up.parent
        stack.extend(c for c in n.children if isinstance(c, Node))
    return root


def _without_comments(root: Node) -> None:
    """Reader comments by their place: a heading or short block that announces them, and what follows it in its
    container. A container that begins with it holds nothing else, so it goes whole, but never an article's element."""
    for n in list(_walk(root)):
        if n.tag in INLINE or n.parent is None or n.noise or any(isinstance(c, Node) and c.tag not in INLINE for c in n.children):
            continue
        own = " ".join(unescape("".join(c for x in _walk(n) for c in x.children if isinstance(c, str))).split()) if len(n.children) < 8 else ""
        if len(own) > 40 or not _COMMENTS.fullmatch(own):
            continue
        siblings = n.parent.children
        at = next(i for i, c in enumerate(siblings) if c is n)
        blocks = [c for c in siblings[at + 1 :] if isinstance(c, Node)]
        alike = [c for c in blocks if not c.noise and c.tag not in HEADINGS]
        first = not any((c if isinstance(c, str) else "x" if not c.noise else "").strip() for c in siblings[:at])
        if len(alike) == 0 or (not first and any(c.tag in HEADINGS for c in blocks)):
            continue  # a heading of the text
        for c in [n, *blocks]:
            c.noise = True


def _article(root: Node) -> str:
    _without_comments(root)
    measure = _lengths(root)
    scored: dict[int, Node] = {}
    for n in _walk(root):
        if n.tag not in PARAGRAPHS:
            continue
        own = [c for c in n.children if isinstance(c, str) or c.tag in INLINE]
        size = sum(len(" ".join(c.split())) if isinstance(c, str) else measure[id(c)][0] for c in own if isinstance(c, str) or not c.noise)
        if not size:
            continue
        commas = sum(c.count(",") if isinstance(c, str) else measure[id(c)][1] for c in own if isinstance(c, str) or not c.noise)
        points, up, share = 1 + commas + min(size / 100, 3), n.parent, 1.0
        for k in range(3):
            if up is None:
                break
            up.score += points * share
            scored[id(up)] = up
            up, share = up.parent, 1 / (k + 2)
    density = lambda n: measure[id(n)][2] / max(1, measure[id(n)][0])
    for n in scored.values():
        n.score = (n.score + 25 * (n.tag in ("article", "main"))) * (1 - density(n))
    if not scored:
        return "\n".join(_blocks([root]))
    best = max(scored.values(), key=lambda n: n.score)
    up = best
    while up.parent:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    own_lists = _lists_of_text(best, density)
    for n in list(_walk(best)):
        if n is not best and n.tag in ("ul", "ol", "div", "section", "table") and density(n) > 0.5 and sum(c.tag == "a" for c in _walk(n)) > 1 and id(n) not in own_lists:
            n.noise = True
    kept = [best]
    if best.parent and best.tag not in ("article", "main"):
        least = max(10.0, 0.2 * best.score)
        kept = [c for c in best.parent.children if isinstance(c, Node) and not c.noise and (c is best or c.score >= least or (c.tag == "p" and measure[id(c)][0] > 80 and density(c) < 0.25))]
    return "\n".join(_blocks(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages(page_id, url, html)``.

    Null or empty html gives an empty text; null ids and urls are passed on; repeated rows give
    repeated results; extra columns are left out. Time is linear in the page; pages are independent.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
