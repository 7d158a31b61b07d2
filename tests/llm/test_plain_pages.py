"""Pages without class names and without an article: the distribution of text alone decides."""

import time

import pytest

from plumbline.llm import htmltext
from plumbline.llm.htmltext import lines_of, main_text

LONG = "these words go on for quite a while and say what the page is about, again and again and again"
MENU = "".join(f"<a href=/{i}>Item {i}</a><br>" for i in range(9))
TALK = "".join(f"<div>user{i}</div><div>Reply</div><div>Like</div>" for i in range(6)) + f"<div>I agree that {LONG}</div>"
FOOT = "<div>About us</div><div>Terms</div><div>Privacy</div>"


def page(body):
    return f"<html><body><div>{MENU}</div>{body}<div>{TALK}</div>{FOOT}</body></html>".encode()


INSIDE = f"<h1>Title</h1><p>one {LONG}</p><p>two {LONG}</p><p>Short.</p><p>three {LONG}</p><p>End.</p>"
WANT = f"Title one {LONG} two {LONG} Short. three {LONG} End."


@pytest.mark.parametrize("body", [f"<div>{INSIDE}</div>", f"<div><div>{INSIDE}</div></div>", f"<table><tr><td>{INSIDE}</td></tr></table>"])
def test_body_in_one_element(body):
    assert main_text(page(body)) == WANT


def test_body_in_the_page_itself_or_in_many_elements():
    assert main_text(page(INSIDE)) == WANT
    many = f"<h1>Title</h1><div>one {LONG}</div><div>two {LONG}</div><div>Short.</div><div>three {LONG}</div>"
    assert main_text(page(many)) == WANT.removesuffix(" End.")


def test_surges_decide(monkeypatch):
    monkeypatch.setattr(htmltext, "surges", lambda sizes, *a: [(0, len(sizes))])
    assert main_text(page(INSIDE)) != WANT and "I agree" in main_text(page(INSIDE))


def test_lines_are_found_in_linear_time():
    def seconds(n):
        html = "<div>" * n + "<b class=x>a</b> " * n + "</i class=y>" * n + "<p>x" * n
        began = time.process_time()
        lines_of(html)
        return time.process_time() - began

    assert seconds(16_000) < 12 * max(seconds(4_000), 0.02)


def test_null_empty_repeated_and_clashing_rows(spark):
    rows = [(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, "t"), (2, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, htmltext.extract(pages).collect()), key=str)
    assert got == [(1, "u", "a", 1), (1, "u", "a", 1), (2, "v", "", 0), (None, None, "", 0)]
    assert htmltext.extract(pages.where("false")).count() == 0
