"""The block rules: each matters, an independent labeller agrees, and odd markup loses no article text."""

import random
import time

import pytest

from scrivano.llm import html

GOOD = "The cat is on the mat and it was the best of times for all of us in the town, as it is to this day."
NAMES = "Smith Jones Brown Taylor Wilson Davies Evans Thomas Roberts Walker Wright Robinson Thompson White Hughes Edwards Green Hall Wood Harris Lewis Martin Jackson Clarke Clark Turner Hill Scott Cooper Morris"
JAPANESE = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。" * 4
RUSSIAN = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме Облонских. " * 3


def page(*blocks):
    return "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>"


def test_each_rule_decides(monkeypatch):
    links = f"<a href=x>{GOOD}</a>"
    short = "A short one"
    text = page(links, "Menu", short, GOOD, "Between", GOOD, NAMES, "After names")
    want = f"{short}\n{GOOD}\nBetween\n{GOOD}"
    assert html.main_text(text) == want
    for name, value in (("LINK_DENSITY", 2.0), ("STOP_DENSITY", 0.0), ("SHORT", 0), ("LONG", 10**6)):
        with monkeypatch.context() as m:
            m.setattr(html, name, value)
            assert html.main_text(text) != want, name
    with monkeypatch.context() as m:
        m.setattr(html, "second_pass", lambda found, labels: [bool(x) for x in labels])
        assert html.main_text(text) == f"{GOOD}\n{GOOD}"


def labelled(found):
    """The two passes said again, block by block: labels of the text that stays."""
    words = [[w for w in html.WORD.findall(b.text.lower())] for b in found]
    stops = [sum(w in html.STOP for w in ws) for ws in words]
    free = [i for i, b in enumerate(found) if not b.outside]
    listed_language = sum(stops[i] for i in free) >= 0.06 * sum(len(words[i]) for i in free)
    first = []
    for b, ws, s in zip(found, words, stops):
        if b.outside or (b.links > 0.5 and not (b.article and not b.listed)):
            first.append("bad")
        elif len(b.text) < 70:
            first.append("")
        elif listed_language and s >= 0.18 * len(ws):
            first.append("good")
        elif len(b.text) >= 200:
            first.append("good" if not listed_language else "" if b.article else "bad")
        else:
            first.append("")
    article = any(b.article and not b.outside and x != "bad" for b, x in zip(found, first))
    out = []
    for i, b in enumerate(found):
        x = first[i]
        if not x and article:
            x = "good" if b.article else "bad"
        elif not x:
            decided = [j for j in range(len(found)) if first[j]]
            following = [j for j in decided if j > i]
            if b.heading and following:
                x = first[following[0]]
            elif decided:
                least = min(abs(j - i) for j in decided)
                x = "good" if any(first[j] == "good" for j in decided if abs(j - i) == least) else "bad"
            else:
                x = "good"
        out.append(x == "good")
    return out


def test_an_independent_labeller_agrees():
    rng = random.Random(1)
    made = [GOOD, "Short", NAMES, "x " * 50, JAPANESE, f"<a href=x>{GOOD}</a>", "<a href=x>Link</a> and some", f"<b>{GOOD}</b>{GOOD}{GOOD}", "<ul><li><a href=x>Home</a><li>Item</ul>"]
    tags = ["div", "p", "nav", "article", "h2", "li", "aside", "section class=ad", "div class=related-work", "header"]
    for _ in range(300):
        text = ""
        for _ in range(rng.randrange(12)):
            tag = rng.choice(tags)
            text += f"<{tag}>{rng.choice(made)}" + (f"</{tag.split()[0]}>" if rng.random() < 0.8 else "")
        found = html.blocks(text)
        want = [b.text for b, good in zip(found, labelled(found)) if good]
        if any(html.first_pass(found)) or not all(x is False for x in html.first_pass(found)):
            assert html.main_text(text) == "\n".join(want)
        else:
            assert html.main_text(text) == ""


@pytest.mark.parametrize("text", [JAPANESE.strip(), RUSSIAN.strip()])
def test_other_languages_stay(text):
    assert html.main_text(page("<a href=x>menu</a>", text, text)) == f"{text}\n{text}"
    assert html.main_text(f"<nav>{text}</nav><p>{text}</p><footer>{text}</footer>") == text


@pytest.mark.parametrize("around", ["<article>{}</article>", '<article class="post has-comments comment">{}</article>', '<div class="content with-sidebar">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="page-container sidebar-left"><article>{}</article></div>', '<div class="header"><main>{}</main></div>', '<html><head><title>t</title><body><div id="social-history">{}</div>'])
def test_containers_of_the_text_stay(around):
    text = around.format(f"<p>{GOOD}</p><p>{GOOD}</p>")
    assert html.main_text(f"<nav>{GOOD}</nav>{text}<aside>{GOOD}</aside>") == f"{GOOD}\n{GOOD}"


def test_inside_an_article():
    inner = f'<p><a href=x>{GOOD}</a></p><blockquote><a href=x>A linked quote</a></blockquote><p class="related-work">{GOOD}</p><div id="social-history">Short.</div>'
    outer = f'<div class="comments"><p>{GOOD}</p></div><article class="comment">{GOOD}</article><div class="share-buttons">Share this</div><div class="ad-slot-1">{GOOD}</div><ul><li><a href=x>One link</a></ul><p hidden>{GOOD}</p>'
    assert html.main_text(f"<article>{inner}{outer}</article>") == f"{GOOD}\nA linked quote\n{GOOD}\nShort."


def test_beside_an_article():
    assert html.main_text(f"<div>Buy now</div><article><h1>Title</h1><p>Short.</p></article><div>© somebody</div>") == "Title\nShort."


def test_headings_take_what_follows():
    assert html.main_text(f"<div><a href=x>Home and more</a></div><h1>Title</h1><p>By me</p><p>{GOOD}</p><h2>Links</h2><p><a href=x>{GOOD}</a></p>") == f"Title\nBy me\n{GOOD}"


@pytest.mark.parametrize("text", ["<div>" * 90_000 + "</b>" * 90_000 + GOOD, "<article>" + "<b x=1>" * 70_000 + "</i>" * 70_000 + GOOD, '<div class="ad">' * 40_000 + GOOD, "<p>" + "<a href=x>" * 90_000 + GOOD, "<i x>" * 60_000 + "</nav>" * 60_000 + "</i>" * 60_000 + GOOD, "<!--" * 200_000 + GOOD, "<a '" * 200_000 + GOOD])
def test_time_grows_with_the_length(text):
    began = time.time()
    html.main_text(text)
    assert time.time() - began < 3
