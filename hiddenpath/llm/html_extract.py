"""Main-text extraction with a linear-chain conditional random field over the leaf blocks of a page.

A page is cut at block-level tags into leaf blocks. Each block has features of its ancestors (tags, and known
words in their classes and ids) and of its text; a chain of two labels, main text or not, is decoded by
Viterbi. The weights are trained on labelled pages: by default on generated ones of many layouts, in
which every block's label is known.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES, STEPS, RATE, DECAY = 600, 150, 0.15, 1e-3
#: Ancestors that hold an article. A page without any is plain: its blocks aren't outside of anything.
HOLDERS = frozenset(("t=article", "t=main", *(f"c={w}" for w in "content article post entry story main prose".split())))

# Element names of HTML. What RAW elements hold is no text of the page; other names are inline unless they are
# of BLOCK or have a hyphen; fallback content, formulas and labels of drawings are text where they stand.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe select noembed noframes".split())
KNOWN_TAGS = frozenset("article main nav header footer aside form ul ol li dl table td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption section div body details dialog address fieldset button noscript".split())
BLOCK = KNOWN_TAGS | frozenset("html head center dir dt dd hgroup legend summary option optgroup menu search tbody thead tfoot tr caption colgroup video audio hr frameset marquee listing xmp plaintext".split())
_LISTS, _ITEMS = ("ul", "ol", "dl", "table"), frozenset("li dt dd tr td th option".split())
# Words in class and id names that tell what an element holds.
HINTS = (
    "ad ads advert advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer copyright "
    "sidebar side widget related recommended share social comment comments reply respond disqus discussion cookie consent notice alert popup modal "
    "newsletter subscribe signup login search form pagination pager tags meta byline legal "
    "content article post entry story body text main page prose"
).split()
_HINT = {w: f"c={w}" for w in HINTS}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r">|=\s*([\"'])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_LONG_REFERENCE = re.compile(r"&#(?:[xX]([0-9a-fA-F]{7,})|([0-9]{8,}));?")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_END = re.compile(r"[.!?…:;»\"”)]\s*$")


@dataclass
class Block:
    text: str
    ancestors: tuple[str, ...]
    parent: str
    link_chars: int


def _decoded(text: str) -> str:
    """Character references decoded; the number of a long one is cut down to what the decoder can take."""

    def shorter(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0")
        return f"&#{'x' if m[1] else ''}{digits or '0'};" if len(digits) < 8 else "\ufffd"

    return html_lib.unescape(_LONG_REFERENCE.sub(shorter, text) if "&#" in text else text) if "&" in text else text


class _Page:
    """A cursor over a page; what a search once did not find after a place is not searched for again."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.lacking: set[str] = set()

    def after(self, mark: str, at: int) -> int:
        """The place after the next ``mark``, or -1."""
        if mark in self.lacking:
            return -1
        k = self.page.find(mark, at)
        if k < 0:
            self.lacking.add(mark)
            return -1
        return k + len(mark)

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` that ends a tag: not one in a quoted value, unless the quote is never closed."""
        while m := _QUOTE_OR_END.search(self.page, at):
            at = m.end()
            if m[1] is None:
                return at
            close = self.after(m[1], at)
            at = close if close >= 0 else at
        return self.size

    def raw_end(self, tag: str, at: int) -> int:
        """The place after a raw element's end tag, or the end of the page."""
        m = _RAW_END[tag].search(self.page, at)
        end = self.after(">", m.end()) if m else -1
        return end if end >= 0 else self.size


class _Stack:
    """Open elements: what is looked up for a tag or a block takes the same time at any depth."""

    def __init__(self) -> None:
        #: Name, features and nearest known name of each open element; places of each name; features in force.
        self.open: list[tuple[str, tuple[str, ...], str]] = []
        self.places: dict[str, list[int]] = {}
        self.active: dict[str, int] = {}

    def last(self, tag: str) -> int:
        return (self.places.get(tag) or (-1,))[-1]

    def push(self, tag: str, hints: tuple[str, ...]) -> None:
        known = tag in KNOWN_TAGS
        parent = tag if known else self.open[-1][2] if self.open else "none"
        names = (f"t={tag}", *hints) if known else hints
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, names, parent))
        for x in names:
            self.active[x] = self.active.get(x, 0) + 1

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, names, _ = self.open.pop()
            self.places[tag].pop()
            for x in names:
                if self.active[x] == 1:
                    del self.active[x]
                else:
                    self.active[x] -= 1

    def start(self, tag: str, hints: tuple[str, ...]) -> None:
        """Opens an element, after the ends that its start tag implies."""
        if self.open and self.open[-1][0] == "p":
            self.cut(len(self.open) - 1)
        elif tag in _ITEMS and (place := self.last(tag)) >= 0 and all(self.last(t) < place for t in _LISTS):
            self.cut(place)
        self.push(tag, hints)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order: character references decoded, white space made single, trimmed.

    The page is gone through once, in time proportional to its length whatever is nested, unclosed or unquoted in it.
    """
    out: list[Block] = []
    stack, cursor = _Stack(), _Page(page)
    parts: list[str] = []
    links, linked = 0, False
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, tuple(stack.active), stack.open[-1][2] if stack.open else "none", min(links, len(text))))
            parts.clear()
        links = 0

    def put(text: str) -> None:
        nonlocal links
        parts.append(_decoded(text))
        if linked:
            links += len(parts[-1])

    while at < size:
        k = page.find("<", at)
        if k < 0:
            put(page[at:])
            break
        if k > at:
            put(page[at:k])
        closing = page.startswith("/", k + 1)
        name = _NAME.match(page, k + 1 + closing)
        if name is None:
            if page.startswith("<!--", k):
                end = cursor.after("-->", k + 4)
            elif page.startswith("<![CDATA[", k) and (end := cursor.after("]]>", k + 9)) >= 0:
                pass
            elif closing or page.startswith(("!", "?"), k + 1):
                end = cursor.after(">", k + 2)
            else:
                put("<")
                end = k + 1
            at = end if end >= 0 else size
            continue
        tag, at = name[0].lower(), cursor.tag_end(name.end())
        if tag in RAW:
            if not closing:
                at = cursor.raw_end(tag, at)
            continue
        if tag in ("br", "hr"):
            parts.append(" ")
        if tag == "a":
            linked = not closing
        block = tag in BLOCK or "-" in tag
        if block:
            flush()
        if not block or tag in VOID:
            continue
        if closing:
            if (place := stack.last(tag)) >= 0:
                stack.cut(place)
            continue
        rest = page[name.end() : at - 1]
        hints = dict.fromkeys(_HINT[p.lower()] for v in _NAMES.findall(rest) for p in _PART.findall(v[0] or v[1] or v[2]) if p.lower() in _HINT) if rest else {}
        stack.start(tag, tuple(hints))
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    held = [any(t in HOLDERS for t in b.ancestors) for b in blocks]
    without = "outside" if any(held) else "plain"
    for i, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        density = b.link_chars / n
        f = ["bias", *b.ancestors, f"p={b.parent}", f"n={min(n.bit_length(), 11)}", f"w={min(words.bit_length(), 8)}"]
        f.append("l=0" if density == 0 else f"l={1 + min(int(density * 4), 4)}")
        if _END.search(b.text):
            f.append("ends")
        if "©" in b.text:
            f.append("sign")
        if words < 4:
            f.append("short")
        if not held[i]:
            f.append(without)
            if without == "plain" and len(b.ancestors) > 1:
                f.append("plain&inside")
        f.append("first" if i == 0 else "last" if i == len(blocks) - 1 else "middle")
        out.append(f)
    return out


@dataclass
class Crf:
    #: Weights of each feature for main text (against other text), and of the four label pairs.
    weights: dict[str, float]
    pairs: np.ndarray

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not rows:
            return []
        (a00, a01), (a10, a11) = self.pairs.tolist()
        get = self.weights.get
        z0, z1 = 0.0, sum(get(f, 0.0) for f in rows[0])
        back = []
        for row in rows[1:]:
            e = sum(get(f, 0.0) for f in row)
            s00, s10, s01, s11 = z0 + a00, z1 + a10, z0 + a01, z1 + a11
            back.append((s10 > s00, s11 >= s01))
            z0, z1 = max(s00, s10), max(s01, s11) + e
        label = z1 > z0
        labels = [label]
        for b in reversed(back):
            label = b[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[list[list[str]]], labels: list[list[bool]], steps: int = STEPS) -> Crf:
    """Maximum likelihood with decay by Adam; pages are padded and go through forward-backward side by side."""
    names = {f: k for k, f in enumerate(sorted({f for p in pages for b in p for f in b}))}
    kept = [k for k, p in enumerate(pages) if p]
    pages, labels = [pages[k] for k in kept], [labels[k] for k in kept]
    longest = max((len(p) for p in pages), default=0)
    n = len(pages)
    if not n:
        return Crf({}, np.zeros((2, 2)))
    cells = np.array([(i * longest + t, names[f]) for i, p in enumerate(pages) for t, b in enumerate(p) for f in b])
    mask = np.array([[t < len(p) for t in range(longest)] for p in pages])
    gold = np.array([[t < len(p) and p[t] for t in range(longest)] for p in labels])
    w, a = np.zeros(len(names)), np.zeros((2, 2))
    theta = [w, a]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in theta]
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(cells[:, 0], w[cells[:, 1]], n * longest).reshape(n, longest)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            go = np.logaddexp.reduce(alpha[:, t - 1, :, None] + a, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], go, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            go = np.logaddexp.reduce(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], go, beta[:, t + 1])
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        state = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]) * mask
        gw = np.bincount(cells[:, 1], (gold - state).reshape(-1)[cells[:, 0]], len(names)) / n - DECAY * w
        both = np.exp(alpha[:, :-1, :, None] + a + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        seen = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & mask[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)])
        ga = (seen - both.sum((0, 1))) / n - DECAY * a
        for x, g, m in zip(theta, (gw, ga), moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Crf({f: float(w[k]) for f, k in names.items()}, a)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 4, plain: bool = False) -> Iterator[tuple[str, set[str]]]:
    """Generated pages of varied layouts, and the texts of their main blocks; all texts of a page differ.

    ``plain`` pages have no element that holds the article, or one that says little, short paragraphs and bare text, and few other parts.
    """
    rng = random.Random(seed)
    syllables = [a + b for a in ("b", "d", "k", "l", "m", "n", "r", "s", "t", "v", "st", "tr", "sch") for b in ("a", "e", "i", "o", "u", "ar", "en", "ion")]

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 5, high: int = 25) -> str:
        return words(low, high).capitalize() + rng.choice("....!?")

    def prose(most: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, most)))

    def links(low: int = 2, high: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(rng.randint(low, high))) + "</ul>"

    def wrap(tags: list[str], names: list[str], inner: str, bare: float = 0.0) -> str:
        tag = rng.choice(tags)
        if tag in ("div", "section", "ul", "ol") and rng.random() >= bare:
            kind = rng.choice(("class", "class", "id"))
            return f'<{tag} {kind}="{rng.choice(names)}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(count):
        main: set[str] = set()

        def keep(text: str, main: set[str] = main) -> str:
            main.add(text)
            return text

        def advert() -> str:
            return wrap(["div", "div", "aside"], ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner"], rng.choice([words(2, 8), sentence(), f"<p>{prose(3)}</p>", f'<a href="/x">{sentence()}</a>']))

        def comments() -> str:
            one = "".join(f"<{t}>{words(1, 2)}</{t}><p>{prose(4)}</p>" if rng.random() < 0.5 else f"<div class=\"comment\"><p>{prose(4)}</p></div>" for t in rng.choices(["h4", "b", "div"], k=rng.randint(1, 6)))
            return wrap(["section", "div", "ol"], ["comments", "comment-list", "discussion", "reader-comments", "disqus"], f"<h3>{words(1, 3)}</h3>" * rng.randint(0, 1) + one)

        def form() -> str:
            return f"<form>{wrap(['div', 'p'], ['field', 'form-row'], f'<label>{words(1, 4)}</label><input name=q>')}<p>{sentence()}</p><button>{words(1, 2)}</button></form>" if rng.random() < 0.6 else wrap(["div"], ["newsletter", "subscribe", "login", "signup", "search-form"], f"<p>{sentence()}</p><form><label>{words(1, 3)}</label><input></form>")

        def side() -> str:
            return wrap(["aside", "div"], ["sidebar", "widget", "related", "side", "recommended"], f"<h3>{words(1, 4)}</h3>" + rng.choice([links(), f"<p>{prose(3)}</p>", f"<p>{prose(2)}</p>" + links()]))

        def notice() -> str:
            if rng.random() < 0.2:
                return f"<noscript>{rng.choice((sentence(), f'<p>{prose(2)}</p>'))}</noscript>"
            close = f"<button>{words(1, 3)}</button>" if rng.random() < 0.3 else ""
            return wrap(["div", "div", "section"], ["cookie-notice", "notice", "alert", "consent", "popup", "cookie-banner"], rng.choice([sentence(), f"<p>{prose(3)}</p>"]) + close)

        title = sentence(4, 12)
        body = [f"<h1>{keep(title)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5) if plain else (1, 2, 3, 4, 6, 9, 14))):
            r = rng.random()
            if plain and r < 0.8:
                text = keep(words(1, 3).capitalize() + "." if rng.random() < 0.35 else prose(rng.choice((1, 1, 2, 5))))
                body.append(rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>", f"<hr>{text}<hr>")))
            elif r < 0.76:
                text = prose(rng.choice((1, 1, 3, 6)))
                if rng.random() < 0.1:
                    text = words(1, 3).capitalize() + "."
                style = rng.random()
                if style < 0.75:
                    body.append(f"<p>{keep(text)}</p>")
                elif style < 0.85:
                    body.append(f"<p><b>{keep(text)}<br>")
                elif style < 0.92:
                    body.append(f"<div>{keep(text)}</div>")
                else:
                    other = words(1, 3)
                    body.append(f'<p>{text} <a href="/y">{other}</a></p>')
                    keep(f"{text} {other}")
            elif r < 0.83:
                body.append(f"<{(h := rng.choice(('h2', 'h3')))}>{keep(words(1, 7).capitalize())}</{h}>")
            elif r < 0.88:
                body.append("<ul>" + "".join(f"<li>{keep(sentence(2, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.91:
                body.append(f"<blockquote>{keep(prose(2))}</blockquote>")
            elif r < 0.93:
                body.append("<table><tr>" + "".join(f"<td>{keep(words(1, 6))}</td>" for _ in range(rng.randint(2, 4))) + "</tr></table>")
            elif r < 0.97:
                body.append(advert())
            else:
                body.append(rng.choice((side, notice, form))())
        inside = "".join(body)
        layout = rng.random()
        if plain:
            if not body:
                inside = rng.choice((f"<p>{keep(sentence(1, 6))}</p>", keep(words(1, 4) + "."), keep(prose(4))))
            inside = rng.choice((inside, inside, f"<div>{inside}</div>", f"<center>{inside}</center>", f"<div id=main>{inside}</div>", f"<div class=text>{inside}</div>"))
            parts = [f"<{t}>{links()}</{t}>" for t in ("nav", "header") if rng.random() < 0.2], [f"<{t}>{rng.choice((f'&copy; {words(1, 3)}', sentence(), f'<p>{sentence()}</p>'))}</{t}>" for t in ("footer", "aside") if rng.random() < 0.25]
            extra = [part() for part in (notice, advert, form, comments) if rng.random() < 0.08]
            yield f"<html><head><title>{title}</title></head><body>{''.join(parts[0])}{inside}{''.join(parts[1] + extra)}</body></html>", main
            continue
        if layout < 0.45:
            inside = f"<article>{inside}</article>"
        elif layout < 0.6:
            inside = f"<main>{inside}</main>"
        elif layout < 0.75:
            inside = f"<main><article>{inside}{comments() if rng.random() < 0.4 else ''}</article></main>"
        else:
            inside = wrap(["div", "section"], ["content", "post", "entry-content", "article-body", "story", "main", "post-body", "page-content", "text"], inside, 0.15)
        top = [wrap(["nav", "nav", "div", "ul"], ["menu", "navbar", "navigation", "breadcrumb", "main-menu"], links())]
        if rng.random() < 0.6:
            top.insert(0, wrap(["header", "div"], ["header", "masthead", "page-header"], f"<p>{rng.choice((words(1, 5), sentence()))}</p>"))
        for part, chance in ((notice, 0.3), (advert, 0.5), (form, 0.2), (side, 0.2)):
            if rng.random() < chance:
                top.append(part())
        bottom = [part() for part, chance in ((comments, 0.4), (side, 0.4), (advert, 0.2), (form, 0.2), (notice, 0.15)) if rng.random() < chance]
        bottom.append(wrap(["footer", "footer", "div"], ["footer", "copyright", "legal"], rng.choice((f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{prose(3)}</p>", links(2, 4) + f"<p>&copy; {words(1, 4)}</p>", sentence()))))
        yield f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(top)}{inside}{''.join(bottom)}</body></html>", main


def train_default(count: int = TRAINING_PAGES) -> Crf:
    """A field trained on generated labelled pages."""
    rows, labels = [], []
    for page, main in [*labelled_pages(count), *labelled_pages(count // 3, seed=40, plain=True)]:
        blocks = leaf_blocks(page)
        rows.append(features(blocks))
        labels.append([b.text in main for b in blocks])
    return train(rows, labels)


def main_text(page: str, crf: Crf) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, crf.decode(features(blocks)), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch], crf: Crf) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(x or "", crf) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """The main text of each page: ``page_id, url, text, n_chars``, a row per input row.

    ``pages`` has ``page_id, url, html``; other columns are ignored. Blocks of main text are joined by a line break in page
    order. Null and empty pages give an empty text; a null page_id or url stays null; rows that repeat are done each. Tags and
    comments that are never closed run to where a browser would end them, or to the end; a quoted value that is never closed ends
    at the next ``>``. Time grows with a page's length, whatever it holds. An empty table gives an empty result.
    """
    crf = crf or train_default()
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(partial(_extract, crf=crf), "page_id long, url string, text string, n_chars long")
