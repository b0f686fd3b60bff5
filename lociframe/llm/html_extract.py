"""Main-text extraction by a linear-chain CRF over a page's leaf blocks.

A page is cut into leaf blocks, stretches of text between block-level tags. Each block's features come from
its ancestors' tags and class words and from its text; a two-label chain (main, other), trained here on
labelled pages, is decoded by Viterbi. The labelled pages are built by ``labelled_pages`` from layouts and
random words, so their number is a parameter and nothing is shipped.

The driver trains once (a few seconds) and broadcasts the weights, whose size is bounded by the feature
names; executors then read each page on its own, without a shuffle.

Defined results: null and empty pages have empty text; broken markup is read as far as it goes: an unclosed comment,
script, style or title runs to the end, other skipped elements that close themselves or are never closed are their tag
only, and a tag without an end is text; long pages are read whole, in time that grows with their length however deep
they nest and whatever is left open; pages are extracted one by one, repeated ones too; an empty table gives
an empty table; all input columns are kept, and those named like a result are replaced.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import named, packed, unpacked

# HTML elements by kind.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style title template noscript iframe svg object select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag on the left closes an open one on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TO_END = frozenset("script style title".split())  # of the skipped ones, those that run to the end if never closed

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_BREAK = re.compile("[>]|=\\s*[\"']")  # the end of a tag, or a quoted value in it
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME_WORD = re.compile("[a-z]+")


@dataclass
class Block:
    text: str
    features: list[str]


class _Stack:
    """Open elements, with a count of each feature that they give a block inside, so that a block needn't walk up to the root."""

    def __init__(self, known: Container[str] | None = None) -> None:
        self.known = known  # features that are of use, all if none are named
        self.tags: list[str] = []
        self.given: list[set[str]] = []
        self.blocks: list[str] = []  # those that are not inline
        self.counts: dict[str, int] = {}
        self.open_tags: dict[str, int] = {}

    def push(self, tag: str, names: list[str]) -> None:
        self.tags.append(tag)
        self.given.append({f for f in (f"in:{tag}", *(f"named:{w}" for w in names)) if self.known is None or f in self.known})
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if tag not in INLINE:
            self.blocks.append(tag)
        for f in self.given[-1]:
            self.counts[f] = self.counts.get(f, 0) + 1

    def pop(self) -> str:
        tag = self.tags.pop()
        self.open_tags[tag] -= 1
        if tag not in INLINE:
            self.blocks.pop()
        for f in self.given.pop():
            if self.counts[f] == 1:
                del self.counts[f]
            else:
                self.counts[f] -= 1
        return tag

    def holds(self, tag: str) -> bool:
        return self.open_tags.get(tag, 0) > 0

    def close(self, tag: str) -> None:
        """Up to the innermost of these elements; nothing where none is open."""
        if self.holds(tag):
            while self.pop() != tag:
                pass

    def open(self, tag: str, names: list[str]) -> None:
        """Closes what an opening tag ends first: the innermost of certain elements, unless another block lies between."""
        closes = CLOSES.get(tag, {"p"} if tag not in INLINE else set())
        if any(self.holds(c) for c in closes):
            for i in range(len(self.tags) - 1, -1, -1):
                if self.tags[i] in closes:
                    while len(self.tags) > i:
                        self.pop()
                    break
                if self.tags[i] not in INLINE and self.tags[i] != "p":
                    break
        self.push(tag, names)

    def features(self) -> set[str]:
        return set(self.counts) | ({f"leaf:{self.blocks[-1] if self.blocks else 'none'}"} if self.tags else set())


class _Ends:
    """Where tags and skipped elements end. What was looked for is kept, so that no stretch is searched again and again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.after: dict[int, int] = {}  # from a break in a tag to the tag's end; -1: none
        self.never: set[str] = set()

    def tag(self, begin: int) -> int:
        """The place of the ``>`` that ends the tag begun here, not one in a quoted value; -1 if there is none."""
        passed, at = [], begin
        while True:
            m = _BREAK.search(self.page, at)
            if m is None or m.start() in self.after:
                end = -1 if m is None else self.after[m.start()]
                break
            passed.append(m.start())
            if m[0] == ">":
                end = m.start()
                break
            close = self.page.find(m[0][-1], m.end())
            if close < 0:
                end = -1
                break
            at = close + 1
        for p in passed:
            self.after[p] = end
        return end

    def element(self, tag: str, at: int) -> int:
        """The end of the closing tag of a skipped element; -1 if there is none."""
        if tag in self.never:
            return -1
        end = re.compile(f"</{re.escape(tag)}[^>]*>", re.IGNORECASE).search(self.page, at)
        if end is None:
            self.never.add(tag)
            return -1
        return end.end()


def leaf_blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """Blocks with text, in page order. Of the features, only the ``known`` ones are given, where named."""
    out: list[Block] = []
    stack = _Stack(known)
    parts: list[str] = []
    linked = 0  # characters inside links
    where: set[str] | None = None
    page, at = page or "", 0
    ends, last_end = _Ends(page), page.rfind(">")

    def flush() -> None:
        nonlocal parts, linked, where
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, _features(where or set(), text, linked)))
        parts, linked, where = [], 0, None

    def add(text: str) -> None:
        nonlocal linked, where
        if where is None and not text.isspace():
            where = stack.features()
        parts.append(text)
        if stack.holds("a"):
            linked += len(text)

    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = len(page) if end < 0 else end + 1
            continue
        name = begin + 1 + page.startswith("/", begin + 1)
        letter = page[name : name + 1]
        stop = ends.tag(begin) if begin < last_end and letter.isascii() and letter.isalpha() else -1
        if stop < 0:
            add("<")
            at = begin + 1
            continue
        m = _TAG.match(page, begin, stop)
        at, closing, tag, inside = stop + 1, m[1], m[2].lower(), page[m.end() : stop]
        if tag in SKIPPED:
            end = -1 if closing or (tag not in TO_END and inside.endswith("/")) else ends.element(tag, at)
            at = end if end >= 0 else len(page) if tag in TO_END and not closing else at
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if closing:
            stack.close(tag)
            continue
        names = [w for x in _NAMES.findall(inside) for w in _NAME_WORD.findall("".join(x).lower())] if "=" in inside else []
        stack.open(tag, names)
    flush()
    return out


def _features(where: set[str], text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    found = {"bias", f"words:{min(8, int(math.log2(words)))}", f"linked:{min(4, 4 * linked // max(1, len(text)))}", f"end:{text[-1] if text[-1] in '.!?:,' else 'other'}"} | where
    if "©" in text:
        found.add("has:copyright")
    return sorted(found)


@dataclass
class Crf:
    """Weights of features by label (0 other, 1 main), and of steps between labels."""

    weights: dict[str, tuple[float, float]]
    steps: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not features:
            return []
        get, none = self.weights.get, (0.0, 0.0)
        (s00, s01), (s10, s11) = self.steps
        a = b = 0.0
        back: list[tuple[int, int]] = []
        for i, fs in enumerate(features):
            e0 = e1 = 0.0
            for f in fs:
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if i == 0:
                a, b = e0, e1
                continue
            from0, from1 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10), (0, a + s01) if a + s01 > b + s11 else (1, b + s11)
            back.append((from0[0], from1[0]))
            a, b = from0[1] + e0, from1[1] + e1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, l2: float = 1e-4, seed: int = 0) -> Crf:
    """Maximum conditional likelihood by AdaGrad steps, a page at a time; gradients by forward-backward."""
    names = {f: i for i, f in enumerate(sorted({f for page, _ in pages for fs in page for f in fs}))}
    w, steps = np.zeros((len(names), 2)), np.zeros((2, 2))
    seen_w, seen_steps = np.full_like(w, 1e-6), np.full_like(steps, 1e-6)
    coded = [([np.array([names[f] for f in fs]) for fs in page], np.array(labels)) for page, labels in pages if page]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(coded)
        for page, labels in coded:
            n = len(page)
            e = np.array([w[fs].sum(0) for fs in page])
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = e[0]
            for i in range(1, n):
                forward[i] = e[i] + np.logaddexp(forward[i - 1, 0] + steps[0], forward[i - 1, 1] + steps[1])
            for i in range(n - 2, -1, -1):
                ahead = e[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(steps[:, 0] + ahead[0], steps[:, 1] + ahead[1])
            total = np.logaddexp(*forward[-1])
            wrong = np.exp(forward + backward - total)
            wrong[np.arange(n), labels] -= 1
            gradient = np.zeros_like(w)
            for fs, g in zip(page, wrong, strict=True):
                gradient[fs] += g
            gradient += l2 * w
            pair = np.zeros((2, 2))
            for i in range(1, n):
                pair += np.exp(forward[i - 1][:, None] + steps + (e[i] + backward[i])[None, :] - total)
                pair[labels[i - 1], labels[i]] -= 1
            seen_w += gradient**2
            seen_steps += pair**2
            w -= rate * gradient / np.sqrt(seen_w)
            steps -= rate * pair / np.sqrt(seen_steps)
    return Crf({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, tuple(tuple(map(float, r)) for r in steps))


def labelled_pages(n: int, seed: int = 0) -> Iterator[tuple[str, set[str]]]:
    """``(html, texts of its main blocks)``: random layouts around an article. No block of other kinds has a main text."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"

    def words(low: int, high: int, style: int = 0) -> str:
        out = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(low, high))]
        if style == 1:
            out = [x.upper() + "!!" for x in out]
        elif style == 2:
            out = [x + rng.choice(["***", "###", "$$$", "%%%"]) for x in out]
        elif style == 3:
            out = [x for x in out for _ in range(5)]
        elif style == 4:
            return " | ".join(out)
        else:
            out[0] = out[0].capitalize()
            return " ".join(out) + rng.choice([".", ".", ".", "!", "?", ""])
        return " ".join(out)

    def links(low: int, high: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/x">{words(1, 3).rstrip(".!?")}</a></{wrap}>' for _ in range(rng.randint(low, high)))

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "section", "aside")) -> str:
        name = rng.choice(names)
        return f"<{(t := rng.choice(tags))} {rng.choice(['class', 'id'])}=\"{name}\">{inner}</{t}>"

    def maybe(p: float, make) -> str:
        return make() if rng.random() < p else ""

    ad = lambda: box(["ad", "ads", "advert", "banner", "sponsored", "promo"], rng.choice(["", "<p>"]) + words(3, 25))
    notice = lambda: box(["cookie", "cookie-notice", "notice", "consent", "popup", "alert", "gdpr"], f"<p>{words(5, 30)}</p><button>{words(1, 2)}</button>")
    share = lambda: box(["share", "social", "related", "tags", "author-box", "newsletter"], f"<ul>{links(2, 5)}</ul>")
    form = lambda: f"<form class=\"{rng.choice(['search', 'newsletter', 'signup', 'login'])}\"><label>{words(1, 6)}</label><input name=q><button>{words(1, 2)}</button></form>"
    sidebar = lambda: rng.choice([box(["sidebar", "widget", "side", "rail"], f"<h3>{words(1, 4)}</h3><ul>{links(3, 8)}</ul><p>{words(5, 40)}</p>"), f"<aside><h3>{words(1, 4)}</h3><p>{words(5, 40)}</p></aside>"])
    comments = lambda: box(["comments", "comment-list", "discussion", "responses", "replies"], f"<h3>{words(1, 3)}</h3>" + "".join(f"<div class=\"{rng.choice(['comment', 'reply'])}\"><p>{words(2, 60)}</p></div>" for _ in range(rng.randint(1, 5))), ("div", "section"))
    menu = lambda: rng.choice([f"<nav><ul>{links(3, 9)}</ul></nav>", box(["menu", "nav", "navbar", "breadcrumb", "navigation"], f"<ul>{links(3, 9)}</ul>", ("div",)), f"<header><a href=/>{words(1, 3)}</a><nav>{links(3, 6, 'span')}</nav></header>"])
    footer = lambda: rng.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer"><p>{}</p></div>']).format(rng.choice(["&copy; ", "", ""]) + words(3, 40))

    for _ in range(n):
        main: set[str] = set()
        style = rng.choice([0, 0, 0, 0, 1, 2, 3, 4])

        def keep(text: str, main: set[str] = main) -> str:
            main.add(" ".join(text.split()))
            return text

        body = f"<h1>{keep(words(2, 12, style))}</h1>"
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.75:
                text = keep(words(3, 120, style))
                body += rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>"])
            elif kind < 0.83:
                body += f"<h2>{keep(words(1, 8, style))}</h2>"
            elif kind < 0.91:
                body += "<ul>" + "".join(f"<li>{keep(words(2, 20, style))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            else:
                body += f"<blockquote>{keep(words(4, 40, style))}</blockquote>"
            body += maybe(0.06, ad) + maybe(0.04, share)
        inner = maybe(0.25, comments)
        article = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post entry">{}</div></div>', "<main>{}</main>"]).format(body + inner)
        page = maybe(0.2, notice) + menu() + maybe(0.3, form) + maybe(0.5, ad) + article + maybe(0.2, share) + maybe(0.25, comments) + maybe(0.4, sidebar) + maybe(0.2, ad) + footer() + maybe(0.1, notice)
        yield f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{page}</body></html>", main


@lru_cache(maxsize=4)
def trained(pages: int, seed: int) -> Crf:
    examples = []
    for page, main in labelled_pages(pages, seed):
        blocks = leaf_blocks(page)
        examples.append(([b.features for b in blocks], [int(b.text in main) for b in blocks]))
    return train(examples)


def extract(page: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(page, crf.weights)
    return "\n".join(b.text for b, label in zip(blocks, crf.decode([b.features for b in blocks]), strict=True) if label)


def extract_main_text(pages: DataFrame, html_column: str = "html", training_pages: int = 400, seed: int = 0) -> DataFrame:
    """``pages`` without the html, with ``text`` (main blocks joined by line ends) and ``n_chars``."""
    crf = pages.sparkSession.sparkContext.broadcast(trained(training_pages, seed))
    given = packed(pages, html_column, html=named(html_column))
    schema = T.StructType([given.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(x, crf.value) for x in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), texts], ["row", "text"])

    return unpacked(given.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long")), "text", "n_chars")
