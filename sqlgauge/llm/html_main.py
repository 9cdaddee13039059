"""Operator 8: the main text of web pages by tree scoring.

The page becomes a tree. What never belongs to an article (scripts, forms,
menus, page headers and footers, side columns, notices, adverts, comments) is
cut off, but no form or marked block that holds the article, most of the page's
text or a section of prose. Every block with text of its own gives points to its ancestors: one, one
more per comma and per hundred characters (three at most), shared out so that
nearer ancestors get more. A candidate's points are discounted by its link
density; the best container wins and grows to the article element around it.
Without one it takes along the blocks of text beside it and beside its ancestors:
those with few links and enough text, of the same class, quoted or preformatted,
or siblings that score well.

Defined results: a null, empty or text-free page gives an empty text; text
outside any element belongs to the page's body; unclosed elements end with their
parent; a page cut off in the middle of a tag ends before it. Nesting of any
depth is walked without recursion.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose text stands apart from its neighbours.
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody "
    "tfoot tr td th pre blockquote figure figcaption address center details summary hgroup header footer "
    "nav aside form fieldset hr br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "br"}
#: A start tag ends an open element of these kinds, up to the given fence.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
          "body": ({"head"}, set())}
DROP = frozenset("script style noscript template head nav aside footer form button input select textarea "
                 "iframe svg canvas object menu dialog title xmp noembed noframes".split())
DROP_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar alert alertdialog "
                      "dialog form".split())
#: Words of class names and ids that mark what surrounds an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription "
    "signup sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar "
    "toolbar footer footers bottom colophon related recommend recommended recommendations share sharing "
    "social widget widgets pagination pager comment comments disqus replies reply respond "
    "discussion skip login alert".split())
COMMENTS = frozenset("comment comments disqus replies reply respond discussion".split())
#: Marks that may also be the subject of a section, and words that deny it.
TOPICS = frozenset(
    "discussion related recommend recommended recommendations notice notices alert header bottom promotion "
    "advertising consent social navigation respond subscription sharing".split())
TEASERS = frozenset("post posts article articles story stories news link links item items product products "
                    "video videos page pages reading content".split())
NOT_OF = frozenset("with has no without".split())
#: Blocks that hold their own text; the text of others counts for what they stand in.
HOLDERS = frozenset("html body article section main div".split())
#: Blocks that are content at any length.
QUOTED = frozenset("pre blockquote".split())
SECTION = 200  # characters out of links of a section of prose
PROSE, LINKED = 100, 0.25  # characters out of links, and share of text in links, of a block of text
LEVELS = 10  # ancestors that a block gives points to
KEEPS = frozenset("html body article main".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                       re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "score", "text", "linked", "holds", "cut",
                 "prose", "links", "clean", "said", "most")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.score, self.text, self.linked, self.holds, self.cut = 0.0, 0, 0, False, False
        self.prose, self.links, self.clean, self.said, self.most = 0, 0, 0, False, False


def parse(html: str) -> Node:
    """A tree of elements and texts; tolerant of unclosed and stray tags."""
    root = node = Node("body", None)
    seen: set[str] = set()
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            node.children.append(html[at:])
            break
        if lt > at:
            node.children.append(html[at:lt])
        nxt = html[lt + 1:lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name_at = lt + 2 if nxt == "/" else lt + 1
        if not html[name_at:name_at + 1].isalpha() or not html[name_at:name_at + 1].isascii():
            if nxt == "/":  # a broken end tag is no text
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                node.children.append("<")
                at = lt + 1
            continue
        m = TAG.match(html, lt) or PLAIN_TAG.match(html, lt)
        if m is None:
            break  # the page ends inside a tag
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            node = _end_tag(node, root, tag) if tag in seen or tag == "body" else node
            continue
        seen.add(tag)
        node = _before(node, tag)
        child = Node(tag, node, attributes)
        node.children.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, at)
            if close is None:
                break
            end = html.find(">", close.start())
            at = n if end < 0 else end + 1
        elif tag not in VOID and not attributes.endswith("/"):
            node = child
    return root


def _end_tag(node: Node, root: Node, tag: str) -> Node:
    at = node
    while at is not None and at.tag != tag:
        at = at.parent
    if at is None or at is root:
        return root if tag in ("body", "html") else node
    return at.parent


def _before(node: Node, tag: str) -> Node:
    """The node under which a start tag opens, after the ends that it implies."""
    if tag in ENDS_P:
        at = node
        while at is not None and at.tag not in ("table", "td", "th", "button", "object"):
            if at.tag == "p":
                node = at.parent
                break
            if at.tag in ENDS_P:
                break
            at = at.parent
    if tag in CLOSES:
        kinds, fence = CLOSES[tag]
        at = node
        while at is not None and at.tag not in fence:
            if at.tag in kinds and at.parent is not None:
                node = at.parent
            at = at.parent
    return node


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _marks(node: Node) -> set[str]:
    """The words of an element's class and id that mark something around an article."""
    if not node.attributes:
        return set()
    a = _attributes(node.attributes)
    found = set()
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [w.lower() for w in WORD.findall(name)]
        found |= {w for before, w in zip(["", *words], words) if w in AROUND and before not in NOT_OF}
    return found


def _own_header(node: Node) -> bool:
    """Whether a header stands inside an article and carries its title."""
    return _inside(node, ARTICLE) and any(x.tag in HEADINGS for x in _walk(node))


def _inside(node: Node, tags: frozenset) -> bool:
    at = node.parent
    while at is not None:
        if at.tag in tags:
            return True
        at = at.parent
    return False


ARTICLE = frozenset(("article", "main"))


def _is_cut(node: Node) -> bool:
    """Whether an element is no part of the article (``holds``: it contains one; ``most``: most text)."""
    tag = node.tag
    if tag in DROP and not (tag == "form" and (node.holds or node.most)):
        return True
    if tag == "header":
        return not _own_header(node)
    if not node.attributes:
        return False
    if tag in KEEPS:
        return tag == "article" and bool(_marks(node) & COMMENTS)
    a = _attributes(node.attributes)
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
        return True
    if node.holds or node.most:
        return False
    if a.get("role", "").lower() in DROP_ROLE:
        return True
    marks = _marks(node)
    return bool(marks) and not (marks == {"header"} and _own_header(node)) and not _is_section(node, marks)


def _is_section(node: Node, marks: set[str]) -> bool:
    """Whether a marked block is a section of prose, such as a paper's discussion."""
    if not (marks <= TOPICS and node.prose >= SECTION and node.links < LINKED * (node.prose + node.links)):
        return False
    if not (_inside(node, ARTICLE) or node.tag == "section"):
        return False
    a = _attributes(node.attributes)
    words = {w.lower() for w in WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    # Neither teasers of other pages nor what readers wrote.
    return not words & TEASERS and not any(x is not node and (x.tag == "form" or _marks(x) & COMMENTS)
                                           for x in _walk(node))


def _measure_raw(root: Node) -> None:
    """Text out of and in links of every element, before anything but scripts, menus and
    hidden parts is cut; marks the elements that hold most of the page's text."""
    order, stack = [], [(root, False)]
    while stack:
        at, in_link = stack.pop()
        if at is not root:
            if at.tag in DROP and at.tag != "form":
                continue
            if at.attributes:
                a = _attributes(at.attributes)
                if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
                    continue
        at.said = bool(_marks(at) & COMMENTS)
        order.append(at)
        in_link = in_link or at.tag == "a"
        for c in at.children:
            if isinstance(c, Node):
                stack.append((c, in_link))
            elif in_link:
                at.links += len(" ".join(c.split()))
            else:
                at.prose += len(" ".join(c.split()))
                at.clean = at.prose
    for at in reversed(order):  # children before parents
        if at.parent is not None:
            at.parent.prose += at.prose
            at.parent.links += at.links
            at.parent.clean += 0 if at.said else at.clean
    # What readers wrote is no measure, unless the page holds nothing else.
    for at in order:
        few_links = at.links < LINKED * (at.prose + at.links)
        if at.said:
            at.most = few_links and at.prose >= SECTION > root.clean and 2 * at.prose > root.prose
        else:
            at.most = few_links and 2 * at.clean > root.clean


def _walk(node: Node):
    """All elements below and with ``node``, in page order; cut ones are skipped."""
    stack = [node]
    while stack:
        at = stack.pop()
        if at.cut:
            continue
        yield at
        stack.extend(c for c in reversed(at.children) if isinstance(c, Node))


def _own_text(node: Node) -> str:
    """The text directly in a block: its own and its inline elements'."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif not c.cut and c.tag not in BLOCK:
            stack.extend(reversed(c.children))
    return " ".join(unescape("".join(parts)).split())


def _link_text(node: Node) -> int:
    total, stack = 0, [(c, False) for c in node.children]
    while stack:
        c, in_link = stack.pop()
        if isinstance(c, str):
            total += len(" ".join(c.split())) if in_link else 0
        elif not c.cut and c.tag not in BLOCK:
            stack.extend((x, in_link or c.tag == "a") for x in c.children)
    return total


def _measure(root: Node) -> list[Node]:
    """Scores of all ancestors of text; returns the candidates in page order."""
    candidates: dict[int, Node] = {}
    for node in _walk(root):
        if node.tag not in BLOCK:
            continue
        own = _own_text(node)
        if not own:
            continue
        linked = min(_link_text(node), len(own))
        points = (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - linked / len(own))
        if node.tag in HEADINGS:
            points /= 2
        at, level = (node if node.tag in HOLDERS else node.parent) or node, 0
        node.text += len(own)
        node.linked += linked
        while at is not None and level < LEVELS:
            at.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            candidates.setdefault(id(at), at)
            at, level = at.parent, level + 1
    for node in reversed(list(_walk(root))):  # children before parents
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
    return list(candidates.values())


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _value(node: Node) -> float:
    return node.score * (1 - _density(node))


def _blocks_of(nodes: list[Node]) -> str:
    """The texts of the blocks under ``nodes`` in page order, joined by one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            c = stack.pop()
            if c is None:
                flush()
            elif isinstance(c, str):
                run.append(c)
            elif not c.cut:
                if c.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(c.children))
        flush()
    return " ".join(out)


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html.replace("\x00", "�"))
    stack = [root]
    while stack:  # which elements hold an article or a main element
        at = stack.pop()
        for c in at.children:
            if isinstance(c, Node):
                if c.tag in ARTICLE and not _marks(c) & COMMENTS:
                    up = at
                    while up is not None and not up.holds:
                        up.holds, up = True, up.parent
                stack.append(c)
    _measure_raw(root)
    stack = [root]
    while stack:
        at = stack.pop()
        at.cut = at is not root and _is_cut(at)
        if not at.cut:
            stack.extend(c for c in at.children if isinstance(c, Node))
    candidates = _measure(root)
    if not candidates:
        return ""
    best = max(candidates, key=_value)  # the first of equals
    top, up = best, best
    while up is not None:
        if up.tag in ARTICLE:
            top = up
            break
        up = up.parent
    if top.parent is None:
        return _blocks_of([top])
    if top.tag in ARTICLE:
        least = max(0.2 * _value(best), 0.5)
        return _blocks_of([c for c in top.parent.children if c is top or isinstance(c, Node) and c.tag in ARTICLE
                           and not c.cut and c.tag != "article" and _value(c) >= least])
    return _blocks_of([_with_company(top, 0.2 * _value(best))])


def _reads_like_text(node: Node, beside: Node) -> bool:
    """Whether a block at the side of a kept one holds text rather than links."""
    if node.text == 0 or _density(node) >= LINKED:
        return False
    if node.text - node.linked >= PROSE or node.tag in QUOTED:
        return True
    name = _attributes(node.attributes).get("class")
    return bool(name) and node.tag == beside.tag and name == _attributes(beside.attributes).get("class")


def _with_company(top: Node, least: float) -> Node:
    """The lowest element around ``top`` and all blocks of text beside it or what it
    stands in; children on the way that are no such blocks are left out of the tree."""
    levels, last = [], 1
    at = top
    while at.parent is not None:
        up, first = at.parent, at is top
        own, linked = len(_own_text(up)), _link_text(up)
        direct = own >= PROSE and linked < LINKED * own
        kept, more = [], direct
        for c in up.children:
            if c is at:
                kept.append(c)
            elif isinstance(c, str) or not c.cut and c.tag not in BLOCK and c.text == 0:
                if direct:
                    kept.append(c)
            elif c.cut or c.tag == "article":
                continue
            elif _reads_like_text(c, at) or first and _value(c) >= max(least, 0.5):
                kept.append(c)
                more = True
            elif (c.tag == "p" or c.tag in HEADINGS) and _density(c) < LINKED:
                kept.append(c)
        levels.append((up, kept))
        last = len(levels) if more else last
        at = up
    for up, kept in levels[:last]:
        up.children = kept
    return levels[last - 1][0]


def extract(html: Column) -> Column:
    """The main text of each page."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in column.to_pylist()], pa.string())
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; other columns are not read."""
    text = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        extract(F.col(html_col)).alias("text"))
    return text.withColumn("n_chars", F.char_length("text").cast("bigint"))
