"""Main text of web pages by tree scoring.

A page becomes a tree. Menus, adverts, forms and the like leave it by tag, role and name; a name
that most of the page's text stands under says nothing, and if no text is left, no name does. Every
paragraph gives points for its length and commas to its ancestors, fewer the farther they are;
an ancestor's points are discounted by the share of its text that stands in links. The best
container and those siblings that score alike or are plain text are kept, in page order.

The work follows the length of a page, whatever its tags: the parser knows at which depths each
element is open, and texts are measured once, bottom up.
"""

import re
from bisect import bisect_right
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame

from linesieve.llm.common import map_texts

# Element names by their role in the format.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td
tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - set("body br html caption tbody td tfoot th thead tr option legend".split())
DROPPED = set("""head script style noscript template nav header footer aside form button select option textarea input label
iframe object embed applet canvas svg math audio video map dialog menu fieldset noembed noframes title""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = set("""navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar
tablist tooltip status""".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
LIST_EDGE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
             "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Words in a class or id that mark something beside the article.
NOT_ARTICLE = set("""ad ads advert adverts advertisement advertising adsense adslot adbox banner-ad sponsor sponsored sponsors promo promos
promoted promotion comment comments commentlist comment-list disqus respond replies reply responses discussion cookie cookies consent
gdpr newsletter subscribe subscription signup signin login popup modal overlay share sharing shares social related recommended
recommendations breadcrumb breadcrumbs pagination pager skip skiplink sidebar sidebars sidenav navbar nav navigation menu menus
masthead outbrain taboola paywall toolbar tooltip widget widgets tags tagcloud notice notices notification notifications alert
alerts announcement disclaimer copyright colophon footer footers topbar hidden""".split())
#: Words that mark something beside the article unless an article word stands with them.
MAYBE_NOT = set("header headers banner aside form forms search meta byline toc info extra secondary bottom".split())
ARTICLE = set("article articles content contents main body post posts entry text story hentry page blog prose".split())
NEVER_DROPPED = {"html", "body", "main", "[root]"}
#: Of these, words of layout, which also name what stands around an article.
LAYOUT = MAYBE_NOT | set("widget widgets sidebar sidebars overlay popup modal toolbar topbar hidden notice notices announcement tags".split())
#: Names of layout and state (no-sidebar, overflow-hidden, comments-open): they do not say what their element is.
STATE = re.compile(r"(?:no|not|non|has|have|with|without|hide|show|overflow)[-_].*|.*[-_](?:open|opened|closed|on|off|enabled|disabled)")

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|/[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "[text]"}

MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2
LINKED = 0.6
#: Ancestors that get points by their distance; above them points fade by a constant share a step.
NEAR = 64
#: Shares of the page's text under a name from which on the name says nothing: for words of layout, for all others.
MOST, NEARLY_ALL = 0.5, 0.9


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "names", "points", "far", "length", "linked", "links", "chars", "commas")

    def __init__(self, tag, parent, dropped=False):
        self.tag, self.parent, self.items, self.dropped, self.names = tag, parent, [], dropped, ()
        self.clear()

    def clear(self):
        """Before a measure: points, text in all and in links, links, and the decoded text's characters and commas."""
        self.points = self.far = 0.0
        self.length = self.linked = self.links = self.chars = self.commas = 0


#: What ends the look-up for an open paragraph that the start of a block closes.
P_BARRIER = {"td", "th", "button", "table", "caption", "object"} | (BLOCK - {"p", "address"})


class Path:
    """The open elements, and for every tag the depths at which it is open."""

    def __init__(self, root: Node):
        self.nodes, self.depths, self.blocks, self.barriers = [root], {}, [], []

    def push(self, node: Node):
        depth = len(self.nodes)
        self.nodes.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCK:
            self.blocks.append(depth)
        if node.tag in P_BARRIER:
            self.barriers.append(depth)

    def cut(self, depth: int):
        """Closes the elements from ``depth`` on."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.depths[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in P_BARRIER:
                self.barriers.pop()

    def last(self, tag: str) -> int:
        """The depth of the innermost open ``tag``, 0 without one."""
        return (self.depths.get(tag) or (0,))[-1]

    def close(self, tag: str):
        """An end tag; an inline one does not close a block."""
        depth = self.last(tag)
        if depth and (tag in BLOCK or depth > (self.blocks or (0,))[-1]):
            self.cut(depth)

    def make_room(self, tag: str):
        """Closes what the start of ``tag`` closes: an open paragraph, list item, cell or the head."""
        if tag in CLOSES_P:
            depth = self.last("p")
            if depth > (self.barriers or (0,))[-1]:
                self.cut(depth)
        if tag in CLOSED_BY:
            edge = max(self.last(t) for t in LIST_EDGE[tag])
            first = [depths[at] for t in CLOSED_BY[tag] if (depths := self.depths.get(t)) and (at := bisect_right(depths, edge)) < len(depths)]
            if first:
                self.cut(min(first))
        if self.nodes[-1].tag == "head" and tag not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
            self.cut(len(self.nodes) - 1)


def _attributes(attributes: str) -> dict[str, str]:
    """The attributes of a tag by their names; of repeated ones the first counts."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _is_beside(tag: str, own: dict[str, str]) -> bool:
    """Whether tag, role or style say that an element is no part of an article."""
    if tag in DROPPED:
        return True
    if not own or tag in NEVER_DROPPED:
        return False
    return "hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").lower() in DROPPED_ROLES or \
        bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I))


def _names(tag: str, own: dict[str, str], in_article: bool) -> tuple[tuple[str, str], ...]:
    """What class and id say against an element: a whole name as ("", word), a part of one as (first part, word).

    Inside an article element only whole names count: a section on related work is part of it.
    """
    tokens = [t for key in ("class", "id") for t in own.get(key, "").split()]
    if not tokens or tag in NEVER_DROPPED:
        return ()
    found, maybe, is_article = set(), set(), False
    for token in tokens:
        whole = token.lower()
        if STATE.fullmatch(whole):
            continue
        parts = [w.lower() for w in WORD.findall(token)]
        is_article |= whole in ARTICLE or not ARTICLE.isdisjoint(parts)
        for word in {whole} if in_article else {whole, *parts}:
            if word in NOT_ARTICLE:
                found.add(("" if word == whole else parts[0], word))
            elif word in MAYBE_NOT:
                maybe.add(("" if word == whole else parts[0], word))
    if not is_article:
        found |= maybe
    if tag == "article" and not in_article:  # one within another is a comment or the like, others are articles whatever their names
        return ()
    return tuple(found)


def parse(html: str) -> Node:
    """The page's tree: items of a node are nodes and texts. Unclosed and stray tags are mended as browsers do in the usual cases."""
    root = Node("[root]", None)
    path = Path(root)
    at, size = 0, len(html)
    lower = None
    while at < size:
        m = TAG.search(html, at)
        if not m:
            break
        if m.start() > at:
            path.nodes[-1].items.append(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            path.close(tag)
            continue
        if tag == "body" or tag == "html":
            continue
        path.make_room(tag)
        node = path.nodes[-1]
        own = _attributes(m[3]) if m[3] else {}
        beside = node.dropped or _is_beside(tag, own)
        child = Node(tag, node, beside)
        if own and not beside:
            child.names = _names(tag, own, path.last("article") > 0)
        node.items.append(child)
        if tag in RAW:
            lower = html.lower() if lower is None else lower
            if len(lower) != size:  # lower-casing moved characters: look without it
                close = re.compile(rf"</{tag}", re.I | re.A).search(html, at)
                end = close.start() if close else size
            else:
                end = lower.find(f"</{tag}", at)
                end = size if end < 0 else end
            if not beside:
                child.items.append(html[at:end])
            close = html.find(">", end)
            at = size if close < 0 else close + 1
        elif tag not in VOID and (not m[3].endswith("/") or tag in BLOCK):
            path.push(child)
    if at < size:
        path.nodes[-1].items.append(html[at:])
    return root


def blocks_of(top: Node) -> list[str]:
    """Texts of the blocks below ``top``, in page order: references decoded, white space made one space, trimmed."""
    out, run = [], []

    def end():
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    stack = [iter([top])]
    closing = [False]
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            if closing.pop():
                end()
        elif isinstance(item, str):
            run.append(item)
        elif not item.dropped:
            block = item.tag in BLOCK
            if block:
                end()
            stack.append(iter(item.items))
            closing.append(block)
    end()
    return out


def _words(text: str) -> tuple[int, int]:
    """Characters of the words of a decoded text, one more for each word, and commas."""
    text = unescape(text) if "&" in text else text
    words = text.split()
    return sum(map(len, words)) + len(words), text.count(",") + text.count("、") + text.count("，")


def _measure(root: Node) -> list[Node]:
    """All elements that are left, parents first, each measured bottom up."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.clear()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node) and not x.dropped]
    for node in reversed(order):
        for item in node.items:
            if isinstance(item, str):
                node.length += len(item.strip())
                chars, commas = _words(item)
            elif item.dropped:
                continue
            else:
                node.length += item.length
                node.linked += item.length if item.tag == "a" else item.linked
                node.links += item.links + (item.tag == "a")
                chars, commas = item.chars, item.commas
            node.chars += chars
            node.commas += commas
    return order


def _paragraph(node: Node) -> tuple[int, int]:
    """Characters and commas of an element's own paragraph: all its text if it is one and holds none, else its loose text."""
    if node.tag in PARAGRAPHS:
        if any(isinstance(x, Node) and x.tag in PARAGRAPHS and not x.dropped for x in node.items):
            return 0, 0
        return max(node.chars - 1, 0), node.commas
    if node.tag not in BLOCK:
        return 0, 0
    chars = commas = 0  # a container's text that stands in no block counts as a paragraph of it
    for x in node.items:
        own = _words(x) if isinstance(x, str) else (0, 0) if x.dropped or x.tag in BLOCK else (x.chars, x.commas)
        chars, commas = chars + own[0], commas + own[1]
    return max(chars - 1, 0), commas


def _score(root: Node) -> list[Node]:
    """Measures every node, passes the paragraphs' points on, and returns the scored containers."""
    order = _measure(root)
    for node in order:
        chars, commas = _paragraph(node)
        if chars < MIN_PARAGRAPH:
            continue
        points = 1 + commas + min(chars / 100, 3)
        up = node.parent if node.tag in PARAGRAPHS else node
        for depth in range(NEAR):
            if up is None:
                break
            up.points += points * (1 if depth == 0 else 0.5 if depth == 1 else 1 / (3 * depth))
            up = up.parent
        else:
            if up is not None:
                up.far += points / (3 * NEAR)
    for node in reversed(order):
        if node.far:
            node.points += node.far
            if node.parent is not None:
                node.parent.far += node.far * (NEAR - 1) / NEAR
    scored = [node for node in order if node.points]
    for node in scored:
        node.points *= 1 - (node.linked / node.length if node.length else 0)
    return scored


def _drop_link_lists(top: Node) -> None:
    """Lists and boxes that consist of links, menus without a name, leave the tree; one between plain texts of the same element stays."""
    stack = [top]
    while stack:
        node = stack.pop()
        lists = {id(x) for x in node.items if isinstance(x, Node) and not x.dropped and x.links >= 2
                 and x.tag in ("ul", "ol", "div", "section", "table", "dl") and x.linked > LINKED * x.length}
        plain = [i for i, x in enumerate(node.items) if (len(x.strip()) >= MIN_PARAGRAPH if isinstance(x, str) else not x.dropped
                 and id(x) not in lists and x.tag not in HEADINGS and x.length - x.linked >= MIN_PARAGRAPH)] if lists else []
        for i, x in enumerate(node.items):
            if isinstance(x, Node) and not x.dropped:
                if id(x) in lists and not plain[:1] < [i] < plain[-1:]:
                    x.dropped = True
                elif id(x) not in lists:
                    stack.append(x)


def _under_names(root: Node) -> tuple[list[Node], Counter, int]:
    """Elements with names against them, how much text stands under each name, and how much there is; links do not count."""
    under, named, stack = Counter(), [], [(root, frozenset(), False)]
    while stack:
        node, names, linked = stack.pop()
        if node.names:
            named.append(node)
            names = names.union(node.names)
        linked = linked or node.tag == "a"
        for x in node.items:
            if isinstance(x, Node):
                if not x.dropped:
                    stack.append((x, names, linked))
            elif not linked:
                under[names] += len(x.strip())
    lengths = Counter({name: 0 for node in named for name in node.names})
    for names, length in under.items():
        for name in names:
            lengths[name] += length
    return named, lengths, sum(under.values())


def _has_text(root: Node) -> bool:
    """Whether there is text that is no heading and no link."""
    stack = [root]
    while stack:
        for x in stack.pop().items:
            if isinstance(x, str):
                if x.strip():
                    return True
            elif not x.dropped and x.tag != "a" and x.tag not in HEADINGS:
                stack.append(x)
    return False


def _scored_without(root: Node, named: list[Node], names: set) -> list[Node]:
    """The scored containers when the elements of these names leave the tree."""
    for node in named:
        node.dropped = not names.isdisjoint(node.names)
    return _score(root)


def main_text(html: str) -> str:
    """The article of one page; empty if it has none."""
    root = parse(html)
    named, lengths, total = _under_names(root)
    names = {name for name, n in lengths.items() if n < (MOST if name[1] in LAYOUT else NEARLY_ALL) * total or not n}
    scored = _scored_without(root, named, names) if named else _score(root)
    if not scored and names and not _has_text(root):
        most = max(lengths[name] for name in names)
        scored = _scored_without(root, named, {name for name in names if lengths[name] < most}) or _scored_without(root, named, set())
    if not scored:
        _drop_link_lists(root)
        return " ".join(blocks_of(root))
    best = max(scored, key=lambda n: n.points)
    best = _widen(best)
    _drop_link_lists(best)
    if best.parent is None:
        return " ".join(blocks_of(best))
    limit = SIBLING_SHARE * best.points
    kept = []
    for x in best.parent.items:
        if x is best or (isinstance(x, Node) and not x.dropped and x.tag != "a" and _belongs(x, limit)):
            kept += blocks_of(x)
    return " ".join(kept)


def _widen(best: Node) -> Node:
    """An article element around the best container holds the whole article, heading and all its sections."""
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            return up
        up = up.parent
    while best.parent is not None and best.parent.parent is not None and \
            sum(isinstance(x, Node) and not x.dropped and x.length > 0 for x in best.parent.items) == 1:
        best = best.parent
    return best


def _belongs(node: Node, limit: float) -> bool:
    """Whether a sibling of the best container is part of the article."""
    density = node.linked / node.length if node.length else 1
    if node.tag in ("h1", "h2", "h3") and node.length:
        return True
    if node.points >= limit:
        return True
    if node.tag in ("p", "pre", "blockquote"):
        return (node.length > 80 and density < 0.25) or (0 < node.length <= 80 and density == 0)
    return False


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``text``, the main text of every page, and ``n_chars``, its code points; columns ``keep`` go along.

    Null and empty pages give an empty text. Pages are read whole, however long. Rows stay as they
    are, repeated ones too; a kept column named like a result gives way.
    """

    def kernel(texts):
        made = [main_text(t) for t in texts]
        return made, [len(t) for t in made]

    return map_texts(pages, kernel, "text string, n_chars long", html, keep)
