"""HTML extraction: hostile pages, odd rows, decoding against all label sequences."""

import itertools
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from hiddenpath.llm import html_extract

HOSTILE = {
    "open tags": "<a " * 350_000,
    "open quotes": '<a b="' * 160_000,
    "mixed quotes": "<a b=\" c=' " * 90_000,
    "nested": "<div class='x'>" * 60_000,
    "script ends": "<script </script " * 60_000,
    "comments": "<!--" * 250_000,
    "cdata": "<![CDATA[" * 110_000,
    "items": "<ul><li>" * 120_000,
    "less than": "<" * 1_000_000,
    "equals": "<a " + "= " * 500_000,
}


@pytest.fixture(scope="module")
def crf():
    return html_extract.train_default(150)


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    began = time.perf_counter()
    blocks = html_extract.leaf_blocks(HOSTILE[kind])
    html_extract.features(blocks)
    assert time.perf_counter() - began < 5


def texts(page):
    return [b.text for b in html_extract.leaf_blocks(page)]


def test_content_is_kept():
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b <object data=x>c <canvas>d</canvas></object> <svg><text>e</text></svg> f</p>") == ["a x=2 b c d e f"]
    assert texts('<p title="a > b">one</p><p x=">two</p>') == ["one", "two"]
    assert texts("<script src=/a/>var x = '<p>';</script><p>1 < 2 & 3 &lt; 4</p>") == ["1 < 2 & 3 < 4"]
    assert texts("<noscript><p>on</p></noscript><button>go</button>z") == ["on", "go", "z"]
    assert texts(f"<p>&#{chr(57) * 6000};&#x{chr(102) * 6000};&#{chr(48) * 6000}65;&amp;</p>") == ["\ufffd\ufffdA&"]
    assert texts("a</>b</ x>c<?php x?>d<!x>e<![CDATA[f]]>g<!--h") == ["abcdeg"]


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(1, 8))
        crf = html_extract.Crf({f"f{k}": float(rng.normal()) for k in range(5)}, rng.normal(size=(2, 2)))
        rows = [[f"f{k}" for k in range(5) if rng.random() < 0.5] for _ in range(n)]
        own = [sum(crf.weights[f] for f in r) for r in rows]

        def score(labels):
            return sum(o for o, x in zip(own, labels) if x) + sum(crf.pairs[a, b] for a, b in zip(labels, labels[1:]))

        assert score([int(x) for x in crf.decode(rows)]) == pytest.approx(max(score(x) for x in itertools.product((0, 1), repeat=n)))


def test_pages_of_another_make(crf):
    """Pages that the generator of the training pages doesn't write: other tags, names, nesting and prose."""
    rng = random.Random(6)
    nouns, verbs = "river harvest museum engine valley committee winter bridge teacher festival".split(), "opened closed changed moved helped reached followed missed".split()

    def line():
        return f"The {rng.choice(nouns)} of the {rng.choice(nouns)} {rng.choice(verbs)} and the {rng.choice(nouns)} {rng.choice(verbs)} it again last year."

    right = total = 0
    for _ in range(30):
        main = [" ".join(line() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 8))]
        page = (
            '<html><body class="home"><div id="top-header"><span>Daily Valley</span></div><ul class="main-nav">' + "".join(f'<li><a href="{k}">{rng.choice(nouns)}</a>' for k in range(5)) + "</ul>"
            f'<div class="wrapper"><div class="post-content"><h1>{(head := line())}</h1>' + "".join(f"<p>{m}" for m in main) + '<aside class="ad-box"><p>Buy now.</p></aside></div>'
            f'<div class="comments"><div><b>Ann</b><p>{line()}</p></div></div></div><div class="footer-legal"><p>&copy; 2020 Valley. {line()}</p></div></body></html>'
        )
        blocks = html_extract.leaf_blocks(page)
        for b, x in zip(blocks, crf.decode(html_extract.features(blocks)), strict=True):
            right += x == (b.text in {head, *main})
            total += 1
    assert right >= 0.95 * total


def test_odd_rows(spark, crf):
    long = "<article>" + "<p>Some words that stand here.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "v", "<p>a", 5), (3, "w", long, 5), (3, "w", long, 5)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"), crf).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == by_id[2].text == "" and by_id[2].url is None
    assert [r.text.count("\n") for r in got if r.page_id == 3] == [19_999] * 2
    assert html_extract.extract_main_text(spark.createDataFrame(rows[:1], "page_id long, url string, html string, n_chars int").limit(0), crf).count() == 0


def test_plain_pages(crf):
    """Pages without an element that holds the article keep all of it."""
    cases = {
        "<body><p>The first one is here.</p><p>And then a second paragraph, a little longer than the first one was.</p><p>A third.</p></body>": "The first one is here.\nAnd then a second paragraph, a little longer than the first one was.\nA third.",
        "<html><body><h1>Some title of a page</h1>Bare text that stands in the body itself, without any element around it.</body></html>": "Some title of a page\nBare text that stands in the body itself, without any element around it.",
        "<body><div id=main>Short.</div></body>": "Short.",
        "<p>Only this.": "Only this.",
        "Nothing but text, and a second sentence.": "Nothing but text, and a second sentence.",
        "<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>All news</a></li></ul></nav><p>What the page says is said here.</p><p>Yes.</p><footer>&copy; somebody</footer></body>": "What the page says is said here.\nYes.",
    }
    assert {k: html_extract.main_text(k, crf) for k in cases} == cases


def test_held_out_plain_pages(crf):
    hit = missed = extra = 0
    for page, main in html_extract.labelled_pages(150, seed=91, plain=True):
        kept = set(html_extract.main_text(page, crf).split("\n")) - {""}
        hit, missed, extra = hit + len(kept & main), missed + len(main - kept), extra + len(kept - main)
    assert hit > 250 and missed + extra < 0.08 * hit


def parsed_blocks(page):
    """Block texts by the standard library's parser: a flush at each block tag, a blank at a line break."""
    out, parts, hidden = [], [], []

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in html_extract.RAW:
                hidden.append(tag)
            if tag in ("br", "hr"):
                parts.append(" ")
            if tag in html_extract.BLOCK or "-" in tag:
                flush()

        def handle_endtag(self, tag):
            if tag in hidden:
                hidden.remove(tag)
            if tag in html_extract.BLOCK or "-" in tag:
                flush()

        def handle_data(self, data):
            if not hidden:
                parts.append(data)

    parser = Parser(convert_charrefs=True)
    parser.feed(page)
    parser.close()
    flush()
    return out


def test_blocks_against_a_second_parser():
    pages = [p for plain in (False, True) for p, _ in html_extract.labelled_pages(60, seed=12, plain=plain)]
    rng = random.Random(6)
    for _ in range(200):
        parts, open_ = ["<body>"], []
        for _ in range(rng.randint(1, 25)):
            r = rng.random()
            if r < 0.4:
                tag = rng.choice(["p", "div", "b", "i", "a", "span", "ul", "li", "table", "tr", "td", "h2", "em", "section", "x-card"])
                parts.append(f"<{tag} {rng.choice(['', 'class=a', 'id=\"x y\"', 'title=\"1 &gt; 0\"'])}>")
                open_.append(tag)
            elif r < 0.6 and open_:
                parts.append(f"</{open_.pop()}>")
            elif r < 0.68:
                parts.append(rng.choice(["<br>", "<hr/>", "<img alt=x>", "<!-- a > b -->", "<script>if (a < b) { x('</p>') }</script>", "<style>p > b {}</style>"]))
            else:
                parts.append(rng.choice(["word ", "two  words", " a &amp; b ", "&eacute;t&#233;", "x\n y", "1 < 2 ", "&copy;"]))
        pages.append("".join(parts))
    for page in pages:
        assert [b.text for b in html_extract.leaf_blocks(page)] == parsed_blocks(page), page
