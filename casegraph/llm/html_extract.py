"""Main text of web pages: boosted trees over DOM nodes with hierarchical decoding.

Every block element and text block of a page is a node that is wholly main text, wholly boilerplate, or mixed. Trees
over its tag, attribute tokens (own and inherited), subtree density, depth and sibling statistics give the chances of
the three. The page is decoded as a whole: below a node that is wholly main text (or boilerplate) everything is, below
a mixed one each child is decided by itself; dynamic programming over the tree finds the likeliest labelling of that
kind, so no two choices on a path contradict each other. The main text is the text blocks labelled main, in order.

The trees are trained here, on pages made by a seeded generator with known main text; no page of the input is used.
`python -m casegraph.llm.html_extract` fits them again and writes the file that `model` reads.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm import boosting
from casegraph.llm.common import bounded_batches
from casegraph.llm.html_dom import Tree, features, parse

MAIN, OUT, MIXED = 0, 1, 2
TRAIN_PAGES, SEED = 1600, 5
FILE = Path(__file__).with_name("html_trees.npz")


class _Maker:
    """Random pages. Main text is marked by a private-use character at the start of each of its text blocks."""

    MARK = ""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(("an", "er", "th", "ou", "que", "sch", "ción", "le", "de", "in", "st", "ra", "é", "ü", "mo", "ti", "on")) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, a: int, b: int) -> str:
        r = self.r
        n = r.randint(a, b)
        out = [self.word() for _ in range(n)]
        for k in range(n - 1):
            if r.random() < 0.1:
                out[k] += r.choice((",", ",", ".", ";", "###", "&amp;&amp;", " |"))
        return " ".join(out).capitalize()

    def sentence(self) -> str:
        return (self.words(1, 3) if self.r.random() < 0.12 else self.words(4, 18)) + self.r.choice((".", ".", ".", "!", "?", ""))

    def attributes(self, names: tuple[str, ...], chance: float) -> str:
        """A class or id with one of the names, perhaps beside others; often none."""
        r = self.r
        if r.random() > chance:
            return r.choice(("", "", f' class="{r.choice(("c1", "box", "row", "wrap", "inner", "x-2b", "block", "col"))}"'))
        name = r.choice(names)
        name = r.choice((name, name, f"{name}-{r.choice(('box', 'wrap', 'inner', '1', 'area'))}", f"{r.choice(('site', 'page', 'js', 'u'))}-{name}", f"{name} {r.choice(('row', 'clearfix', 'dark'))}"))
        quote = r.choice(('"', '"', "'"))
        return f" {r.choice(('class', 'class', 'id', 'role'))}={quote}{name}{quote}"

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.15:
            words = text.split(" ")
            k = r.randrange(len(words))
            tag = r.choice(("b", "i", "em", "strong", "span", 'a href="/x"', "code"))
            words[k] = f"<{tag}>{words[k]}</{tag.split(' ')[0]}>" if r.random() < 0.9 else f"<{tag}>{words[k]}"
            text = " ".join(words)
        return text + ("<br>" if r.random() < 0.08 else "")

    def paragraph(self, main: bool, short: float = 0.25) -> str:
        r = self.r
        n = r.randint(1, 2) if r.random() < short else r.randint(2, 9)
        if r.random() < 0.04:  # a word or two, or a formula
            text = r.choice((self.words(1, 2) + r.choice((".", "", "!")), f"<math><mi>{self.word()}</mi><mo>=</mo><mn>{r.randint(1, 99)}</mn></math>"))
            return f"<p>{self.MARK if main else ''}{text}</p>"
        text = self.inline((self.MARK if main else "") + " ".join(self.sentence() for _ in range(n)))
        return f"<p>{text}" + ("</p>" if r.random() < 0.9 else "")

    def links(self, n: int) -> str:
        r = self.r
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n)]
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if r.random() < 0.9 else "") for x in items) + "</ul>"
        return r.choice((" | ", " ", " &middot; ")).join(items)

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        inner = self.links(self.r.randint(3, 12))
        return f"<{tag}{self.attributes(('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'main-menu', 'topnav', 'pagination'), 0.3 if tag == 'nav' else 0.9)}>{inner}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        inner = self.r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<p>{self.words(2, 9)}</p>", f"<a href='/'>{self.words(1, 3)}</a>", self.sentence()))
        inner += self.r.choice(("", self.menu(), f"<p>{self.sentence()}</p>"))
        return f"<{tag}{self.attributes(('header', 'masthead', 'site-header', 'top', 'banner', 'page-header'), 0.4 if tag == 'header' else 1)}>{inner}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = r.choice(("footer", "footer", "div"))
        parts = [f"&copy; {self.word()}.example.com &middot; {self.sentence()}", self.links(r.randint(2, 6)), self.paragraph(False), self.sentence()]
        r.shuffle(parts)
        return f"<{tag}{self.attributes(('footer', 'site-footer', 'bottom', 'page-footer', 'copyright', 'legal'), 0.3 if tag == 'footer' else 1)}>{''.join(parts[: r.randint(1, 3)])}</{tag}>"

    def sidebar(self) -> str:
        r = self.r
        tag = r.choice(("aside", "aside", "div", "section"))
        parts = [f"<h3>{self.words(1, 4)}</h3>" + self.links(r.randint(2, 8)), self.paragraph(False), self.paragraph(False) + self.paragraph(False), self.advert(), self.form()]
        return f"<{tag}{self.attributes(('sidebar', 'side', 'widget', 'related', 'right-rail', 'complementary', 'popular', 'recommended'), 0.5 if tag == 'aside' else 1)}>{''.join(r.sample(parts, r.randint(1, 3)))}</{tag}>"

    def advert(self) -> str:
        r = self.r
        inner = r.choice((" ".join(self.sentence() for _ in range(r.randint(1, 4))), self.paragraph(False), f'<a href="/buy">{self.words(2, 9)}</a>', f"<p>{self.sentence()}</p><a href='/b'>{self.words(1, 3)}</a>"))
        return f"<{r.choice(('div', 'div', 'div', 'section', 'aside'))}{self.attributes(('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad', 'ad-slot', 'sponsor'), 1)}>{inner}</div>".replace("<section", "<div").replace("<aside", "<div")

    def notice(self) -> str:
        r = self.r
        inner = r.choice((self.paragraph(False), " ".join(self.sentence() for _ in range(r.randint(1, 3))) + f" <button>{self.words(1, 2)}</button>", f"<p>{self.sentence()}</p><a href='/ok'>OK</a>"))
        return f"<div{self.attributes(('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'popup', 'modal', 'gdpr', 'warning', 'message', 'cookie-banner'), 1)}>{inner}</div>"

    def form(self) -> str:
        r = self.r
        tag = r.choice(("form", "form", "form", "div"))
        inner = f"<label>{self.words(1, 5)}</label><input name=q>" + r.choice(("", f"<p>{self.sentence()}</p>", f"<textarea>{self.words(1, 4)}</textarea>")) + f"<button>{self.words(1, 2)}</button>"
        return f"<{tag}{self.attributes(('search', 'newsletter', 'subscribe', 'login', 'signup', 'contact-form', 'form'), 0.5 if tag == 'form' else 1)}>{inner}</{tag}>"

    def comments(self) -> str:
        r = self.r
        one = lambda: f"<{(t := r.choice(('div', 'li', 'div', 'article')))}{self.attributes(('comment', 'reply', 'comment-body'), 0.85)}>" + r.choice(("", f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 2)}</h4>")) + "".join(self.paragraph(False) for _ in range(r.randint(1, 2))) + f"</{t}>"
        inner = r.choice(("", f"<h3>{self.words(1, 3)}</h3>")) + "".join(one() for _ in range(r.randint(1, 7))) + r.choice(("", self.form()))
        return f"<{(t := r.choice(('div', 'section', 'div', 'ul')))}{self.attributes(('comments', 'comment-list', 'disqus', 'discussion', 'replies', 'reader-comments', 'responses-comments'), 1)}>{inner}</{t}>"

    def share(self) -> str:
        return f"<div{self.attributes(('share', 'social', 'sharing', 'social-links', 'share-tools'), 1)}>{self.links(self.r.randint(2, 5))}</div>"

    def points(self) -> str:
        """A list of the main text; in half of them items are links, or have one."""
        r, mark = self.r, self.MARK
        link = lambda: f'<a href="/{self.word()}">{self.words(1, 6)}</a>'
        item = r.choice((
            lambda: self.words(2, 20), lambda: self.words(2, 20), lambda: self.sentence(), link, lambda: f"{self.words(1, 9)} {link()}", lambda: f"{link()} {self.words(1, 12)}",
            lambda: f"<p>{mark}{self.words(2, 9)} {link()}</p>",
        ))
        tag = r.choice(("ul", "ul", "ol"))
        items = (x if "<p>" in (x := item()) else mark + x for _ in range(r.randint(1, 8)))
        return f"<{tag}>{''.join(f'<li>{x}' + ('</li>' if r.random() < 0.9 else '') for x in items)}</{tag}>"

    def bare(self) -> str:
        """What isn't main text within an article and has nothing but its tag to tell it by."""
        r = self.r
        inner = r.choice((f"<p>{self.sentence()}</p>", self.sentence(), f"<h3>{self.words(1, 4)}</h3><p>{self.sentence()}</p>", self.paragraph(False), self.links(r.randint(1, 5))))
        form = f"<form><label>{self.words(1, 4)}</label><input>" + r.choice(("", f"<p>{self.sentence()}</p>", f"<select><option>{self.word()}</select>")) + f"<button>{self.words(1, 2)}</button></form>"
        return r.choice((f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", form, f"<nav>{self.links(r.randint(1, 5))}</nav>", f"<footer>{self.sentence()}</footer>", f"<form>{self.sentence()}<input></form>"))

    def article(self) -> str:
        r, mark = self.r, self.MARK
        head = f"<h1>{mark}{self.words(2, 12)}</h1>"
        if r.random() < 0.15:
            head = f"<header>{head}" + r.choice(("", f"<p>{mark}{self.sentence()}</p>")) + "</header>"
        n = r.choice((1, 1, 2, 3, 5, 8, 12, 20, 35))
        body = [self.paragraph(True, r.random() * 0.6) for _ in range(n)]
        for _ in range(r.randint(0, 2)):
            extra = r.choice((
                f"<h2>{mark}{self.words(2, 8)}</h2>",
                self.points(),
                self.points(),
                f"<blockquote>{self.paragraph(True)}</blockquote>",
                f"<pre>{mark}{self.words(4, 30)}</pre>",
                f"<table>{''.join(f'<tr><td>{mark}{self.words(1, 3)}</td><td>{mark}{self.words(1, 3)}</td></tr>' for _ in range(r.randint(2, 5)))}</table>",
                f"<figure><img src=x><figcaption>{mark}{self.words(3, 12)}</figcaption></figure>",
            ))
            body.insert(r.randint(0, len(body)), extra)
        for make, chance in ((self.advert, 0.3), (self.share, 0.12), (self.form, 0.12), (self.notice, 0.08), (self.sidebar, 0.08), (self.bare, 0.3), (self.bare, 0.15)):
            if r.random() < chance:
                body.insert(r.randint(0, len(body)), make())
        if r.random() < 0.12:
            body.append(self.comments())
        if r.random() < 0.1:
            body = [f"<div{self.attributes(('content', 'text', 'body'), 0.6)}>{''.join(body)}</div>"]
        if r.random() < 0.06:  # text right in the container, parted by other elements
            body = [f"{mark}{self.sentence()} {self.sentence()}{x if x.startswith('<div') else f'<p>{mark}{self.sentence()}</p>'}" for x in body]
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        chance = 0.3 if tag in ("article", "main") else 0.85
        return f"<{tag}{self.attributes(('content', 'article', 'post', 'main', 'entry-content', 'story', 'article-body', 'post-body', 'main-content', 'text'), chance)}>{head if r.random() < 0.9 else ''}{''.join(body)}</{tag}>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.04:  # no more than a text
            return "".join(self.paragraph(True, 0.7) for _ in range(r.choice((1, 1, 2, 4))))
        if r.random() < 0.03:
            return f"<html><body>{self.article()}"
        top = [make() for make, chance in ((self.header, 0.6), (self.menu, 0.6), (self.notice, 0.3), (self.advert, 0.35), (self.form, 0.15)) if r.random() < chance]
        middle = [self.article()]
        if r.random() < 0.35:
            middle.insert(r.randint(0, 1), self.sidebar())
        if r.random() < 0.25:
            middle.append(self.comments())
        if r.random() < 0.2:
            middle.append(r.choice((self.advert, self.share, self.menu))())
        if r.random() < 0.4:
            middle = [f"<{(t := r.choice(('div', 'main', 'div')))}{self.attributes(('wrapper', 'container', 'page', 'main', 'content'), 0.7)}>{''.join(middle)}</{t}>"]
        bottom = [make() for make, chance in ((self.footer, 0.85), (self.notice, 0.15), (self.menu, 0.1)) if r.random() < chance]
        r.shuffle(top)
        script = '<script>var t="</p>";track(1);</script>' if r.random() < 0.5 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style>{script}</head><body>{''.join(top)}<!-- x -->{''.join(middle + bottom)}" + ("</body></html>" if r.random() < 0.9 else "")


def labels(tree: Tree) -> np.ndarray:
    """True labels of a made page's nodes."""
    n = len(tree.tag)
    main, out = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(n - 1, -1, -1):
        if tree.text[k]:
            main[k] |= _Maker.MARK in tree.text[k]
            out[k] |= _Maker.MARK not in tree.text[k]
        if k:
            main[tree.parent[k]] |= main[k]
            out[tree.parent[k]] |= out[k]
    return np.where(main & out, MIXED, np.where(main, MAIN, OUT))


def without_marks(tree: Tree) -> None:
    tree.text = [t.replace(_Maker.MARK, "").strip() for t in tree.text]


def made(pages: int = TRAIN_PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes with text of `pages` made pages."""
    maker = _Maker(seed)
    xs, ys = [], []
    for _ in range(pages):
        tree = parse(maker.page())
        y = labels(tree)
        without_marks(tree)
        x = features(tree)
        there = x[:, _chars()] > 0
        xs.append(x[there])
        ys.append(y[there])
    return np.concatenate(xs), np.concatenate(ys)


def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> boosting.Forest:
    """Trees fitted on `pages` made pages; the same for the same arguments."""
    return boosting.fit(*made(pages, seed), 3)


def fingerprint(pages: int = 20) -> int:
    """Changes with the generator and the features, so that a file of trees fitted before can be told."""
    x, y = made(pages)
    return zlib.crc32(np.round(x, 3).astype("<f4").tobytes() + y.astype("<i8").tobytes())


def write(path: Path = FILE) -> None:
    f = train()
    np.savez_compressed(path, feature=f.feature, threshold=f.threshold, leaf=f.leaf, classes=f.classes, depth=f.depth, start=f.start, made=fingerprint())


@lru_cache(maxsize=1)
def model(path: Path = FILE) -> boosting.Forest:
    """The trees of a file."""
    with np.load(path) as f:
        return boosting.Forest(f["feature"], f["threshold"], f["leaf"], int(f["classes"]), int(f["depth"]), f["start"])


@lru_cache(maxsize=1)
def _chars() -> int:
    """Column of the subtree's text length."""
    from casegraph.llm.html_dom import NUMBERS, TAGS, TOKENS

    return len(TAGS) + 2 * (len(TOKENS) + 1) + NUMBERS.index("chars")


def decode(tree: Tree, scores: np.ndarray) -> np.ndarray:
    """Label of each node under the likeliest labelling without contradictions; scores are log-chances [node, 3]."""
    n = len(tree.tag)
    whole = scores[:, :2].copy()  # all of the subtree main, or boilerplate
    leaf = np.ones(n, bool)
    leaf[[p for p in tree.parent if p >= 0]] = False
    below = np.zeros(n)
    best = [0.0] * n
    w0, w1, mixed = whole[:, 0].tolist(), whole[:, 1].tolist(), scores[:, 2].tolist()
    is_leaf, free, parent = leaf.tolist(), below.tolist(), tree.parent
    for k in range(n - 1, -1, -1):
        best[k] = max(w0[k], w1[k]) if is_leaf[k] else max(w0[k], w1[k], mixed[k] + free[k])
        if k:
            p = parent[k]
            w0[p] += w0[k]
            w1[p] += w1[k]
            free[p] += best[k]
    out = [0] * n
    for k in range(n):
        above = out[parent[k]] if k else MIXED
        if above != MIXED:
            out[k] = above
        elif not is_leaf[k] and mixed[k] + free[k] >= max(w0[k], w1[k]):
            out[k] = MIXED
        else:
            out[k] = MAIN if w0[k] > w1[k] else OUT
    return np.array(out)


def main_blocks(trees: list[Tree], model: boosting.Forest) -> list[list[str]]:
    """Main text blocks of each tree, in page order."""
    xs = [features(t) for t in trees]
    sizes = np.cumsum([len(x) for x in xs])
    scores = model.scores(np.concatenate(xs)) if xs else np.zeros((0, 3))
    empty = np.concatenate([x[:, _chars()] == 0 for x in xs]) if xs else np.zeros(0, bool)
    scores[empty] = 0
    out = []
    for t, end in zip(trees, sizes, strict=True):
        label = decode(t, scores[end - len(t.tag) : end])
        out.append([x for x, y in zip(t.text, label.tolist(), strict=True) if x and y == MAIN])
    return out


def extract(pages: DataFrame, trees: boosting.Forest | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row of `pages` (page_id, url, html), blocks joined by \\n.

    Character references are decoded and white space within a block is one space. Formulas and drawings keep their text;
    noscript and templates, which a page doesn't show, have none. Null, empty and textless pages give
    an empty text. Whole pages are read, whatever their length and however broken; repeated rows give repeated rows,
    extra columns are ignored and an empty table stays empty.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trees or model())  # some 100 trees of depth 4

    def run(batches):
        for batch in batches:
            texts, parsed, nodes = [], [], 0
            for page in batch.column(2).to_pylist():
                parsed.append(parse(page or ""))
                nodes += len(parsed[-1].tag)
                if nodes > 20_000:
                    texts += main_blocks(parsed, shared.value)
                    parsed, nodes = [], 0
            texts += main_blocks(parsed, shared.value)
            joined = ["\n".join(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, pa.string()), pa.array([len(x) for x in joined], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    write()
