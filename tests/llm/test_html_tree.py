"""Operator 10 against pages that are written from a known tree, with the exact text each must give."""

import html
import random

import pytest

from evalloom.llm import op10_html

WORDS = "river stone market copper window season letter garden signal harbour winter engine marble forest silver bridge candle meadow".split()
NAMES = ["social-policy", "reader", "reviews", "related-work", "alert-levels", "feedback-loop", "share-prices", "modal-verbs", "menu-of-options", "history", "x"]


def sentence(rng, n=None):
    words = rng.choices(WORDS, k=n or rng.randint(8, 16))
    return f"{words[0].title()} {' '.join(words[1:4])}, {' '.join(words[4:])} & so on."


def paragraph(rng):
    return " ".join(sentence(rng) for _ in range(rng.randint(2, 4)))


def article(rng, out):
    """Html of an article; its texts are appended to ``out`` in page order."""

    def p(tag="p"):
        text = paragraph(rng)
        out.append(text)
        first, rest = text.split(" ", 1)
        return f"<{tag}><em>{html.escape(first)}</em>\n  {html.escape(rest)}</{tag}>"

    title = sentence(rng, 5)
    out.append(title)
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for _ in range(rng.randint(2, 4)):
        parts.append(p())
    for name in rng.sample(NAMES, 3):
        heading = "Of " + rng.choice(WORDS) + " and " + rng.choice(WORDS)
        out.append(heading)
        tag = rng.choice(["section", "div"])
        inner = [p(rng.choice(["p", "p", "blockquote"])) for _ in range(rng.randint(2, 4))]
        parts.append(f"<{tag} id='{name}'><h2>{heading}</h2>{''.join(inner)}</{tag}>")
    return "".join(parts)


def chrome(rng):
    """What is not the article: boxes, each with its html."""
    short = lambda: html.escape(sentence(rng, 6))
    comments = "".join(f"<li class=c><b>{rng.choice(WORDS).title()}</b><p>{short()}</p></li>" for _ in range(rng.randint(2, 5)))
    return {
        "before": [f"<header><p>{short()}</p></header>", f"<nav><ul>{''.join(f'<li><a href=/{w}>{w}</a></li>' for w in rng.sample(WORDS, 5))}</ul></nav>", f"<div class='cookie-notice'><p>{short()}</p></div>", f"<div class=ad>{short()}</div>"],
        "after": [f"<section id=comments><p>{short()}</p></section>", f"<ol class=voices>{comments}</ol>", f"<aside><p>{short()}</p></aside>", f"<form><label>{short()}</label></form>", f"<footer>{short()}</footer>", "<script>var a = '<p>No, never.</p>';</script>", f"<!-- <p>{short()}</p> -->"],
    }


@pytest.mark.parametrize("seed", range(60))
def test_pages_from_a_tree(seed):
    rng, want = random.Random(seed), []
    body = article(rng, want)
    boxes = chrome(rng)
    before, after = ("".join(rng.sample(boxes[k], rng.randint(1, len(boxes[k])))) for k in ("before", "after"))
    inner = rng.choice(["<article>{}</article>", "<main><article class=post>{}</article></main>", "<main>{}</main>"]).format(body)
    page = f"<!DOCTYPE html><html><head><title>{WORDS[0]}</title></head><body>{before}<div class='page has-sidebar'>{inner}</div>{after}</body></html>"
    assert op10_html.main_text(page) == "\n".join(want)


def test_interviews_stay_and_comments_go():
    say = "".join(f"<p>Number {k} is a sentence, and it says something.</p>" for k in range(4))
    talk = "".join(f"<div><b>Ann Lee</b><p>Answer {k} goes on for a while, as it was said.</p></div>" for k in range(4))
    assert op10_html.main_text(f"<body><article>{say}{talk}</article>").count("Answer") == 4
    thread = "".join(f"<div class=r><b>Bob</b><p>Nice, {k}.</p></div>" for k in range(3))
    assert "Nice" not in op10_html.main_text(f"<body><article>{say}<div>{thread}</div></article>")
    assert "Nice" not in op10_html.main_text(f"<body><main><article>{say}</article><div>{thread}</div></main>")


def test_a_short_article_beside_a_long_advert():
    page = "<body><div class=ad>A long advert, with many words, and one more. Indeed, one more.</div><article><h1>Short.</h1><p>So short.</p></article>"
    assert op10_html.main_text(page) == "Short.\nSo short."


def test_nested_marks_take_linear_time():
    import time

    page = "".join(f"<div class='ad x{k}'>" for k in range(45_000)) + "<p>One sentence, and it is all.</p>"
    begin = time.process_time()
    assert op10_html.main_text(page) == "One sentence, and it is all."
    assert len(page) > 900_000 and time.process_time() - begin < 5
