"""Long rows and large counts: time in proportion, finite values, and pages whose main text is known."""

import random
import time

import numpy as np
import pytest

from weftline.llm import ctw, htmltext, secrets
from weftline.llm._text import U


@pytest.mark.parametrize("n", [100, 2 * 10**7, 10**8, 10**12])
def test_a_context_with_one_follower_scores_others_finitely(n):
    code = np.array([ord("a") | ord("a") << 8 | ord("a") << 16], U)
    tree = ctw.Tree(ctw._levels(code, np.array([n]), 0, 2, 1))
    other = code ^ U(0x80)  # another first bit; the seven behind it were never seen
    assert tree.slow(other)[0] == pytest.approx(np.log10(0.5 / (n + 1)) - 7 * np.log10(2), abs=1e-3)
    assert tree.slow(code)[0] == pytest.approx(8 * np.log10((n + 0.5) / (n + 1)), rel=1e-3, abs=1e-12)


def seconds(make):
    began = time.time()
    make()
    return time.time() - began


PAGES = {
    "nested": "<div>abc, def.", "unclosed": "<a ", "quotes": "<a \"", "both quotes": "<b '\"<i \"'", "declarations": "<!x", "scripts": "<script></script",
    "closing only": "</div></section>", "tags cut short": "<", "classes": "<div class='x'>text, text.", "entities": "&lt;&#",
}


@pytest.mark.parametrize("name", PAGES)
def test_long_pages_take_time_in_proportion(name):
    assert seconds(lambda: htmltext.extract("<p>Begin, here.</p>" + PAGES[name] * 50_000)) < 5


def test_deep_pages_with_ends_that_match_nothing():
    for page in ("<div>" * 50_000 + "<li>x</li>" * 50_000, "<div>" * 50_000 + "x</section>" * 50_000, "<header>" * 30_000 + "<ul><li>" * 30_000 + "y"):
        assert seconds(lambda page=page: htmltext.extract(page)) < 10


def test_links_around_blocks_and_inline_adverts():
    body = "".join(f"<p>This is paragraph {i}, which says something, and ends.</p>" for i in range(6))
    page = f"<div><a href=x><div>Home page link, one.</div><div>Next page link, two.</div></a>{body}<p><span class='ad'>Buy now, <span>cheap</span>!</span></p><p>Kept<i style='display: none'> unseen</i>, and read to its end, by all.</p></div>"
    got = htmltext.extract(page).split("\n")
    assert got == [f"This is paragraph {i}, which says something, and ends." for i in range(6)] + ["Kept, and read to its end, by all."]
    assert htmltext.extract(f"<div><a name=top><p>First, of all.</p>{body}</div>").startswith("First, of all.\nThis is paragraph 0,")
    assert htmltext.extract(f"<div><p><a href=x>open, not closed</p>{body}</div>").count("\n") >= 5  # the link ends with its paragraph


def page_and_text(draw: random.Random) -> tuple[str, list[str]]:
    """A page made of parts whose kind is known, and the lines of its article."""
    word = lambda: "".join(draw.choice("abcdeilmnorstu") for _ in range(draw.randint(2, 9)))
    said = lambda n: (" ".join(word() + ("," if draw.random() < 0.1 else "") for _ in range(n))).rstrip(",").capitalize() + "."
    link = lambda: f"<a href='/{word()}'>{word().capitalize()} {word()}</a>"
    name = lambda *known: draw.choice([*known, word(), word()])  # noqa: E731  classes on the lists and others
    menu = lambda: f"<div class='{name('menu', 'nav')}'><ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randint(4, 12))) + "</ul></div>"
    lines, parts = [], []
    title = said(4).rstrip(".")
    lines.append(title)
    parts.append(f"<h1>{title}</h1>")
    for _ in range(draw.randint(5, 12)):
        if draw.random() < 0.2:
            lines.append(said(3).rstrip("."))
            parts.append(f"<h2>{lines[-1]}</h2>")
        words = said(draw.randint(25, 90))
        lines.append(words)
        cut = words.split(" ")
        cut[3] = f"<em>{cut[3]}</em>"
        if draw.random() < 0.3:
            cut[7] = f"<a href='/x'>{cut[7]}</a>"
        parts.append(f"<p class='{name('text')}'>" + " \n".join(cut) + "</p>")
        if draw.random() < 0.15:
            parts.append(f"<div class='ad'><p>{said(6)}</p></div>")
        if draw.random() < 0.1:
            parts.append(menu())
    root = draw.choice(["article", "div", "section"])
    body = f"<{root} class='{name('post')}'>{''.join(parts)}</{root}>"
    side = f"<div class='{draw.choice(['sidebar', 'related'])}'>" + "".join(f"<p>{said(5)} {link()}</p>" for _ in range(3)) + "</div>"
    notes = "<div class='comments'>" + "".join(f"<div><p>{said(draw.randint(5, 30))}</p></div>" for _ in range(draw.randint(0, 5))) + "</div>"
    head = f"<head><title>{said(4)}</title><script>if (a < b) {{ x(\"</p>\") }}</script><style>p > a {{}}</style></head>"
    order = [menu(), f"<div class='{word()}'>{body}{draw.choice(['', side])}</div>", side, notes, menu(), f"<footer><p>{said(8)}</p></footer>"]
    return f"<html>{head}<body>{''.join(order)}</body></html>", lines


def test_pages_whose_main_text_is_known():
    draw, whole, right, wrong, lost = random.Random(11), 0, 0, 0, 0
    for _ in range(300):
        page, want = page_and_text(draw)
        got = htmltext.extract(page).split("\n")
        whole += got == want
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want))
        lost += len(set(want) - set(got))
    assert whole >= 285 and lost <= 0.01 * right and wrong <= 0.01 * right, (whole, right, wrong, lost)


def test_one_long_span_beside_many_parts():
    far = "\n" * 3 + " ".join(f"login=user{i} x" for i in range(20_000))
    near = " ".join(f"token=Ab{i}xyz7890 y" for i in range(20_000))
    text = f"secret={'Q' * 300_000} {near}{far}"
    base = secrets.base_spans(text)
    assert seconds(lambda: secrets.linked_spans(text, base)) < 5


def test_parts_beside_each_other_as_all_against_all():
    draw = random.Random(4)
    for _ in range(300):
        spans = [(s, s + draw.randint(1, 40)) for s in (draw.randint(0, 300) for _ in range(draw.randint(0, 12)))]
        cuts, reach = sorted(draw.sample(range(340), draw.randint(0, 4))), draw.choice([0, 10, 60])
        near, taken = secrets._Near(spans, reach, cuts), secrets._Taken(spans)
        place = lambda x, cuts=cuts: sum(c <= x for c in cuts)
        for start in range(0, 340, 3):
            end = start + draw.randint(1, 30)
            want = any((e <= start or s >= end) and max(s - end, start - e) <= reach and place(s) == place(start) for s, e in spans)
            assert near.beside(start, end) == want
            assert taken.free(start, end) == all(e <= start or s >= end for s, e in spans)
