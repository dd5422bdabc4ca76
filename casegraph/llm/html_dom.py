"""A small, forgiving HTML tree: block elements, their text blocks, and measures of each node."""

from __future__ import annotations

import html
import re

import numpy as np

#: Elements whose content is no text of the page, and those among them that go on to the end if nothing ends them.
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "select", "title", "button"}
UNENDED = {"script", "style", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "legend", "hr",
}
#: What a start tag ends if it is open, and what bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_TO_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_NAMED = {"class", "id", "role", "itemprop", "name", "aria-label", "rel"}

#: Attribute tokens by what they tell; fixed lists of common names.
TOKENS = {
    "main": "article body content main post entry story text blog prose page column".split(),
    "menu": "nav navigation menu navbar topbar breadcrumb breadcrumbs pagination pager links toc tabs sitemap".split(),
    "head": "header masthead top logo brand hero site".split(),
    "foot": "footer foot bottom copyright legal colophon".split(),
    "side": "sidebar side aside rail widget related recommended popular trending complementary more".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense outbrain taboola".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay warning toast message paywall".split(),
    "comment": "comment comments disqus reply replies respond discussion feedback".split(),
    "form": "form search login signup subscribe newsletter contact register input subscription".split(),
    "share": "share social sharing follow tools print tags meta author byline date".split(),
}
_GROUP = {word: k for k, words in enumerate(TOKENS.values()) for word in words}
TAGS = ("article", "main", "section", "div", "p", "heading", "li", "list", "table", "nav", "header", "footer", "aside", "form", "quote", "figure", "body", "#text", "other")
_TAG_GROUP = {t: k for k, t in enumerate(TAGS)} | {f"h{k}": 5 for k in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), 7)
_TAG_GROUP |= dict.fromkeys(("td", "tr", "th", "tbody", "thead"), 8) | dict.fromkeys(("blockquote", "pre"), 14) | {"figcaption": 15, "html": 16, "dt": 6, "dd": 6, "fieldset": 13}
_OTHER = len(TAGS) - 1


class Tree:
    """Nodes in page order; node 0 is the page. A node is a block element or a text block between block elements."""

    __slots__ = ("attributes", "fields", "links", "parent", "tag", "text")

    def __init__(self):
        self.tag: list[str] = ["html"]
        self.parent: list[int] = [-1]
        self.text: list[str] = [""]
        self.links: list[int] = [0]
        self.fields: list[int] = [0]
        self.attributes: list[str] = [""]

    def add(self, tag: str, parent: int, attributes: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append("")
        self.links.append(0)
        self.fields.append(0)
        self.attributes.append(attributes)
        return len(self.tag) - 1


class _Open:
    """The open elements: a stack, and where in it each tag and the block elements stand, so that no look-up goes through it."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]  # tags with their nearest node
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags) -> int:
        """Where the innermost of the tags stands; 0 if none does."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self, to: int) -> bool:
        """Close what stands at `to` and above; whether there was a block element among it."""
        for tag, _ in self.stack[to:]:
            self.places[tag].pop()
        del self.stack[to:]
        block = False
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
            block = True
        return block


class Tags:
    """Iterates over (begin, end, tag, attributes) of the tags of a page from `at`, which may be set forward meanwhile.

    An end tag's name begins with a slash, comments and declarations have an empty one. A `<` before no name is text. A
    tag ends at the first `>` outside quotes, or at the first at all from where quotes are left open; without a further
    `>` all is text but an unended comment.
    """

    def __init__(self, page: str):
        self.page, self.at, self.quoted = page, 0, True

    def __iter__(self):
        page, n = self.page, len(self.page)
        while (begin := page.find("<", self.at)) >= 0:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                self.at = n if end < 0 else end + 3
                yield begin, self.at, "", ""
                continue
            end = page.find(">", begin)
            if page.startswith(("<!", "<?"), begin):
                self.at = n if end < 0 else end + 1
                yield begin, self.at, "", ""
                continue
            if end < 0:
                begin = page.find("<!", begin)
                if begin >= 0:
                    yield begin, n, "", ""
                return
            name = _NAME.match(page, begin + 1)
            if not name:
                self.at = begin + 1
                continue
            whole = _TO_END.match(page, name.end()) if self.quoted else None
            self.quoted = whole is not None
            self.at = whole.end() if whole else end + 1
            yield begin, self.at, name[0].lower(), page[name.end() : self.at - 1]


def parse(page: str) -> Tree:
    """The tree of a page, in time that grows with its length: stray ends are ignored, what is open at the end is closed there.

    Content of scripts, styles, templates, noscript, frames, form fields and buttons, and the title, is no text; unknown elements,
    formulas and drawings are text of their place.
    """
    tree = Tree()
    open_ = _Open()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                k = tree.add("#text", open_.stack[-1][1])
                tree.text[k] = text
                tree.links[k] = min(len(text), linked)
        linked = 0

    def close(to: int) -> None:
        # the text before belongs to what is closed
        if open_.blocks and open_.blocks[-1] >= to:
            flush()
        open_.pop(to)

    at, lower = 0, None
    unended: set[str] = set()
    found = Tags(page)
    for begin, end, tag, attributes in found:
        if begin > at:
            parts.append(page[at:begin])
            if open_.places.get("a"):
                linked += begin - at
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            k = open_.last((tag[1:],))
            if k:
                close(k)
            elif tag == "/p":
                flush()
        elif tag == "br":
            parts.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "input":
                tree.fields[open_.stack[-1][1]] += 1
        elif tag in RAW:
            if tag in ("textarea", "select", "button"):
                tree.fields[open_.stack[-1][1]] += 1
            if attributes.rstrip().endswith("/"):
                continue
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else page
            stop = -1 if tag in unended else lower.find(f"</{tag}", at)
            if stop >= 0:
                stop = page.find(">", stop)
                found.at = at = len(page) if stop < 0 else stop + 1
            else:
                unended.add(tag)
                found.at = at = len(page) if tag in UNENDED else at
        else:
            if tag in BLOCK:
                flush()
                if open_.blocks and open_.stack[open_.blocks[-1]][0] == "p":
                    close(open_.blocks[-1])
            if tag in ENDS:
                ends, bound = ENDS[tag]
                if (k := open_.last(ends)) > open_.last(bound):
                    close(k)
            if tag in ("html", "head") and len(open_.stack) == 1:
                continue
            open_.push(tag, tree.add(tag, open_.stack[-1][1], attributes) if tag in BLOCK else open_.stack[-1][1])
    parts.append(page[at:])
    flush()
    return tree


def attribute_groups(raw: str) -> np.ndarray:
    """How often an element's attributes hold tokens of each group, and whether it is hidden."""
    out = np.zeros(len(TOKENS) + 1, np.float32)
    if not raw or raw.isspace():
        return out
    for name, value in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in _NAMED or name.startswith("data-"):
            for token in _TOKEN.findall(value):
                k = _GROUP.get(token.lower())
                if k is not None:
                    out[k] += 1
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and "true" in value.lower():
            out[-1] = 1
    return out


_N_GROUPS = len(TOKENS) + 1
NUMBERS = (
    "depth", "order", "siblings", "same_tag", "chars", "share", "before", "link_share", "nodes", "chars_a_node", "marks", "fields", "paragraphs", "long_share",
    "parent_share", "children", "has_heading", "copyright", "mean_block", "longest", "previous_chars", "next_chars",
)
#: Groups of tags of which a node is told whether it is anywhere below one.
WITHIN = tuple(TAGS.index(t) for t in ("article", "main", "section", "list", "table", "nav", "header", "footer", "aside", "form", "quote", "figure"))
N_FEATURES = len(TAGS) + 2 * _N_GROUPS + len(NUMBERS) + len(TAGS) + len(WITHIN)


def features(tree: Tree) -> np.ndarray:
    """[node, feature]: tag, own and inherited attribute tokens, subtree density, depth, sibling statistics, tag of the
    parent, tags of all ancestors."""
    n = len(tree.tag)
    parent = np.array(tree.parent)
    tag = np.array([_TAG_GROUP.get(t, _OTHER) for t in tree.tag])
    chars = np.array([len(t) for t in tree.text], np.float64)
    marks = np.array([t.count(",") + t.count(".") + t.count("?") + t.count("!") for t in tree.text], np.float64)
    copyright_ = np.array([float("©" in t) for t in tree.text])
    links, fields = np.array(tree.links, np.float64), np.array(tree.fields, np.float64)
    is_text = chars > 0
    nodes, blocks = np.ones(n), is_text.astype(np.float64)
    paragraphs = ((tag == 4) & True).astype(np.float64)
    heading = (tag == 5).astype(np.float64)
    long_ = np.where(chars >= 80, chars, 0.0)
    longest = chars.copy()
    own = np.zeros((n, _N_GROUPS), np.float32)
    for k, raw in enumerate(tree.attributes):
        if raw:
            own[k] = attribute_groups(raw)
    total = np.stack([chars, marks, copyright_, links, fields, nodes, blocks, paragraphs, heading, long_])
    inherited = np.zeros((n, _N_GROUPS), np.float32)
    depth, order, siblings, before = np.zeros(n), np.zeros(n), np.zeros(n), np.cumsum(chars) - chars
    seen: dict[tuple[int, int], int] = {}
    plist = tree.parent
    rows = total.T.copy()
    for k in range(n - 1, 0, -1):
        p = plist[k]
        rows[p] += rows[k]
        if longest[k] > longest[p]:
            longest[p] = longest[k]
    count = [0] * n
    last_child: list[int] = [-1] * n
    previous = np.full(n, -1)
    following = np.full(n, -1)
    for k in range(1, n):
        p = plist[k]
        depth[k] = depth[p] + 1
        order[k] = count[p]
        count[p] += 1
        if last_child[p] >= 0:
            previous[k] = last_child[p]
            following[last_child[p]] = k
        last_child[p] = k
        key = (p, int(tag[k]))
        seen[key] = seen.get(key, 0) + 1
    carried = own.any()
    if carried:
        for k in range(1, n):
            inherited[k] = np.maximum(inherited[plist[k]], own[plist[k]])
    counts = np.array(count, np.float64)
    up = np.maximum(parent, 0)
    siblings = counts[up]
    same = np.array([seen.get((plist[k], int(tag[k])), 1) for k in range(n)], np.float64)
    chars, marks, copyright_, links, fields, nodes, blocks, paragraphs, heading, long_ = rows.T
    whole = max(1.0, chars[0])
    some = np.maximum(chars, 1)
    side = lambda at: np.where(at >= 0, np.log1p(chars[np.maximum(at, 0)]), -1.0)
    numbers = np.stack([
        depth, order / np.maximum(siblings, 1), siblings, same, np.log1p(chars), chars / whole, before / whole, links / some, np.log1p(nodes), np.log1p(chars / nodes),
        100 * marks / some, fields, np.log1p(paragraphs), long_ / some, chars / np.maximum(chars[up], 1), counts, np.minimum(heading, 3), np.minimum(copyright_, 2),
        np.log1p(chars / np.maximum(blocks, 1)), np.log1p(longest), side(previous), side(following),
    ], axis=1)
    one_hot = np.zeros((n, len(TAGS)), np.float32)
    one_hot[np.arange(n), tag] = 1
    above = one_hot[up]
    bits, below = (1 << tag).tolist(), [0] * n
    for k in range(1, n):
        below[k] = below[plist[k]] | bits[plist[k]]
    within = (np.array(below)[:, None] >> np.array(WITHIN)) & 1
    return np.concatenate([one_hot, own, inherited, numbers.astype(np.float32), above, within.astype(np.float32)], axis=1)
