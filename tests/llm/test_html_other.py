"""HTML extraction on pages of another hand than those that the trees are fitted on."""

import random

import pytest

from casegraph.llm import html_extract
from casegraph.llm.html_dom import parse

NOUNS = "river market engine valley harbor winter school garden letter signal copper meadow ticket island planet orchard".split()
VERBS = "crosses follows repairs measures watches carries opens remembers describes divides".split()


def phrase(r):
    return f"the {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)}"


def said(r, n=None):
    return ", while ".join(phrase(r) for _ in range(n or r.randint(1, 4))).capitalize() + "."


def paragraph(r):
    text = " ".join(said(r) for _ in range(r.randint(2, 5)))
    return f"<p>{text}</p>", [text]


def points(r):
    """A list with links, all of an item or a part of it."""
    shown, told, kind = [], [], r.randrange(3)
    for _ in range(r.randint(2, 6)):
        a, b = said(r, 1), phrase(r)
        html, text = ((f'<a href="/{r.choice(NOUNS)}">{b}</a>', b), (f'{a} <a href="#{b[:3]}">{b}</a>', f"{a} {b}"), (a, a))[kind]
        shown.append(f"<li>{html}</li>")
        told.append(text)
    tag = r.choice(("ul", "ol"))
    return f"<{tag}>{''.join(shown)}</{tag}>", told


def nothing(kind):
    def make(r):
        return {
            "aside": f"<aside><p>{said(r, 1)}</p></aside>", "button": f"<button>{phrase(r).title()}</button>", "form": f"<form><label>{r.choice(NOUNS)}</label><input type=email><button>{r.choice(VERBS)}</button></form>",
            "field": f"<form action=/go><p>{said(r, 1)}</p><input name=x></form>",
        }[kind], []

    return make


def page(r, extra):
    parts = [f"<h1>{phrase(r).title()}</h1>"]
    main = [parts[0][4:-5]]
    body = [paragraph(r) for _ in range(r.choice((1, 3, 8)))]
    for make in extra:
        body.insert(r.randint(1, len(body)), make(r))
    for html, told in body:
        parts.append(html)
        main += told
    menu = "".join(f"<a href=/{n}>{n.title()}</a> " for n in r.sample(NOUNS, 5))
    return f"<html><head><title>{main[0]}</title></head><body><nav>{menu}</nav><article>{''.join(parts)}</article><footer>{said(r, 1)}</footer></body></html>", main


CASES = {"plain": [], "links": [points], "two lists": [points, points], "aside": [nothing("aside")], "button": [nothing("button")], "form": [nothing("form")], "field": [nothing("field")], "all": [points, nothing("aside"), nothing("form")]}


@pytest.mark.parametrize("case", CASES)
def test_pages_of_another_hand(case):
    r, right = random.Random(case), 0
    made = [page(r, CASES[case]) for _ in range(1000)]
    got = html_extract.main_blocks([parse(html) for html, _ in made], html_extract.model())
    right = sum(a == b for a, (_, b) in zip(got, made, strict=True))
    assert right >= 950, next((html, a, b) for a, (html, b) in zip(got, made, strict=True) if a != b)
