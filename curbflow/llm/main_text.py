"""Main text of web pages: a recurrent block labeller.

A page is read into its leaf blocks in order: runs of text between block-level tags. Each block is a vector: the summed
embeddings of its hashed tag path (tags, classes and ids, near and far), the mean embedding of its hashed words, and a
few measures. A bidirectional LSTM reads the whole sequence both ways, so every block is classified in the light of all
others. The weights are trained here on pages that a generator writes with known labels, in many layouts.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curbflow.llm.common import binary, slices, table

PATH_PLACES, WORD_PLACES = 4096, 4096
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 24, 6, 5, 16
#: Pages that the generator writes for training, passes over them, pages of a step.
PAGES, PASSES, STEP_PAGES, RATE = 1600, 8, 32, 0.01
SEED = 7
#: Blocks of the padded sequences that are run together.
CELLS = 16_384
#: Path elements that count, from the block upwards.
DEPTH = 8
#: Words whose place a task remembers at a time.
REMEMBERED = 300_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
HIDDEN_TEXT = frozenset("script style noscript template iframe svg math object head title select option button textarea datalist canvas audio video".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of these closes an open element of the second set, up to a container.
CLOSES = {
    **{t: frozenset({"p"}) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
}
#: Start tags that an open head survives; others, and text, end it, as its end tag is optional.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes".split())
#: Elements that a block ends if they have no end tag; of the second set, none holds another of its kind.
UNCLOSED, FLAT = frozenset("svg math object select option button datalist canvas audio video".split()), frozenset("select option button".split())
CONTAINERS = frozenset("html body article aside blockquote div dl fieldset figure footer form header main nav ol section table ul".split())

#: What ends a tag's part outside quotes: its end, or a quote, which counts as one only after an equals sign.
_STOP = re.compile(r""">|=\s*(["'])""")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag without attribute values, in which no quote can begin.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>=]*+)>")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Token(NamedTuple):
    start: int
    end: int
    tag: str  # in lower case; empty for comments, declarations and elements whose content is no markup
    closing: bool
    empty: bool  # ends in a slash
    rest: str  # what follows the name


def scan(page: str) -> Iterator[Token]:
    """The markup of a page in order, in time linear in its length.

    A tag ends at the first > outside quotes. A quote without an end is a character; where quotes leave no end to the
    tag, it ends at the first > of all, and without any it runs to the end of the page, as comments do.
    """
    ended = {'"': len(page), "'": len(page)}  # from here on there is no such quote
    dead: set[int] = set()  # quotes from which no > outside quotes follows

    def tag_end(at: int) -> int:
        first, met = page.find(">", at), []
        if first < 0:
            return len(page)
        while stop := _STOP.search(page, at):
            if not (quote := stop[1]):
                return stop.start()
            at = stop.end()
            if at in dead:
                break
            close = page.find(quote, at) if at < ended[quote] else -1
            if close < 0:
                ended[quote] = min(ended[quote], at)
            else:
                met.append(at)
                at = close + 1
        dead.update(met)
        return first

    at = page.find("<")
    while at >= 0:
        if name := _PLAIN.match(page, at):
            end, stop = name.end(), name.end() - 1
        elif name := _TAG.match(page, at):
            stop = tag_end(name.end())
            end = min(len(page), stop + 1)
        elif page[at + 1 : at + 2] in ("!", "?"):
            opening, closing = ("<!--", "-->") if page.startswith("<!--", at) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", at) else ("<!", ">")
            end = page.find(closing, at + len(opening))
            end = len(page) if end < 0 else end + len(closing)
            yield Token(at, end, "", False, False, "")
        else:
            end = at + 1
        if name:
            closing, tag = name[1], name[2].lower()
            if stop == len(page):
                tag = ""
            elif tag in RAW and not closing:
                last = _RAW_END[tag].search(page, end)
                tag, end = "", last.end() if last else len(page)
            yield Token(at, end, tag, bool(closing), page[stop - 1] == "/", page[name.end(2) : stop])
        at = page.find("<", end)


def unclosed(tokens: list[Token]) -> set[int]:
    """Where the start tags of UNCLOSED elements without an end tag begin."""
    found: set[int] = set()
    opened: dict[str, list[int]] = {tag: [] for tag in UNCLOSED}
    for token in tokens:
        if token.tag not in UNCLOSED or not token.closing and token.empty:
            continue
        if not token.closing:
            if token.tag in FLAT and opened[token.tag]:
                found.add(opened[token.tag].pop())
            opened[token.tag].append(token.start)
        elif opened[token.tag]:
            opened[token.tag].pop()
    return found.union(*opened.values())


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # the nearest DEPTH elements (tag, parts of class, id and role), outermost first
    linked: float  # share of the text inside links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Character references are decoded and white space made single spaces.

    Time is linear in the page, however deep its elements are nested: open elements are looked up by their tag.
    """
    found: list[Block] = []
    stack: list[str] = []
    path: list[tuple[str, tuple[str, ...]]] = []  # of the elements that are not inline
    opened: dict[str, list[int]] = defaultdict(list)  # tag -> places in the stack
    inner: list[dict[str, list[int]]] = [defaultdict(list)]  # the same for what is open inside each container
    starts: list[tuple[int, int]] = []  # of the open hidden elements: place in the stack, and in the page
    text: list[str] = []
    broken: set[int] | None = None
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            line = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if line:
                found.append(Block(line, tuple(path[-DEPTH:]), min(1.0, linked / max(1, len(raw)))))
            text.clear()
        linked = 0

    def open_up(tag: str, names: tuple[str, ...], start: int) -> None:
        at = len(stack)
        stack.append(tag)
        opened[tag].append(at)
        if tag not in INLINE:
            path.append((tag, names))
            inner[-1][tag].append(at)
        if tag in CONTAINERS:
            inner.append(defaultdict(list))
        if tag in HIDDEN_TEXT:
            starts.append((at, start))

    def close(upto: int) -> None:
        while len(stack) > upto:
            tag = stack.pop()
            opened[tag].pop()
            if tag in CONTAINERS:
                inner.pop()
            if tag not in INLINE:
                path.pop()
                inner[-1][tag].pop()
            if tag in HIDDEN_TEXT:
                starts.pop()

    def in_head() -> bool:
        return bool(starts) and stack[-1] == "head"

    at, tokens = 0, list(scan(page))
    for token in tokens:
        run = page[at : token.start]
        if in_head() and run.strip():
            close(len(stack) - 1)
        if run and not starts:
            text.append(run)
            linked += len(run) * bool(opened["a"])
        at, tag = token.end, token.tag
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if token.closing:
            if opened[tag]:
                close(opened[tag][-1])
            continue
        if in_head() and tag not in IN_HEAD:
            close(len(stack) - 1)
        if starts and tag in CLOSES:
            if broken is None:
                broken = unclosed(tokens)
            upto = len(stack)
            for place, start in reversed(starts):
                if start not in broken:
                    break
                upto = place
            close(upto)
        if (ends := CLOSES.get(tag)) and (place := max((inner[-1][e][-1] for e in ends if inner[-1][e]), default=-1)) >= 0:
            close(place)
        if tag not in VOID and not token.empty:
            names = tuple(_PART.findall(" ".join(filter(None, (g for m in _NAMES.findall(token.rest) for g in m))).lower())) if "=" in token.rest else ()
            open_up(tag, names, token.start)
    if in_head() and page[at:].strip():
        close(len(stack) - 1)
    if at < len(page) and not starts:
        text.append(page[at:])
    flush()
    return found


@cache
def _place(name: str, places: int) -> int:
    return zlib.crc32(name.encode()) % places


def path_places(path: tuple) -> list[int]:
    """Hashed places of the path's elements: by themselves, with their height over the block, and of their names."""
    out = []
    for height, (tag, names) in enumerate(reversed(path[-DEPTH:])):
        out += [_place(tag, PATH_PLACES), _place(f"{tag}^{min(height, 3)}", PATH_PLACES)]
        out += [_place("." + n, PATH_PLACES) for n in names[:6]]
    return out or [_place("", PATH_PLACES)]


class Words:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def places(self, text: str) -> list[int]:
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for word in text.lower().split():
            place = known.get(word)
            if place is None:
                place = known[word] = zlib.crc32(word.strip(".,;:!?()").encode("utf-8", "replace")) % WORD_PLACES
            out.append(place)
        return out


def measures(own: list[Block]) -> np.ndarray:
    rows = [(min(2.0, np.log1p(len(b.text)) / 5), b.linked, min(1.0, 20 * sum(map(b.text.count, ".,;!?")) / len(b.text)), i / len(own), 1.0) for i, b in enumerate(own)]
    return np.array(rows, dtype=np.float32).reshape(-1, MEASURES)


def bags(own: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated places, and where each block's begin."""
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    return np.concatenate([np.empty(0, dtype=np.int64), *[np.array(x, dtype=np.int64) for x in own]]), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(own) else size


def summed(table: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each block's places; every block has one at least."""
    return np.add.reduceat(table[places], starts, axis=0) if len(places) else np.zeros((len(starts), table.shape[1]), dtype=table.dtype)


class Pages(NamedTuple):
    """Several pages' blocks in one line, and the pages' sizes."""

    path: tuple[np.ndarray, np.ndarray]
    word: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    measures: np.ndarray
    sizes: list[int]


def featurise(pages: list[list[Block]], words: Words) -> Pages:
    every = [b for own in pages for b in own]
    word = [words.places(b.text) for b in every]
    return Pages(bags([path_places(b.path) for b in every]), bags(word), np.array([[len(x)] for x in word], dtype=np.float32).reshape(-1, 1), np.concatenate([np.empty((0, MEASURES), dtype=np.float32), *[measures(own) for own in pages if own]]), [len(own) for own in pages])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, a forward and a backward LSTM, and a logistic layer over both states."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        wide = PATH_SIZE + WORD_SIZE + MEASURES
        new = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"path": 0.1 * draw.standard_normal((PATH_PLACES, PATH_SIZE)).astype(np.float32), "word": 0.1 * draw.standard_normal((WORD_PLACES, WORD_SIZE)).astype(np.float32), "out": new(2 * HIDDEN, 1), "bias": np.zeros(1, dtype=np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": new(wide, 4 * HIDDEN), f"h{way}": new(HIDDEN, 4 * HIDDEN), f"c{way}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    def inputs(self, pages: Pages) -> np.ndarray:
        return np.concatenate([summed(self.p["path"], *pages.path), summed(self.p["word"], *pages.word) / pages.counts, pages.measures], axis=1)

    @staticmethod
    def layout(sizes: list[int], way: str) -> np.ndarray:
        """Step by page: the place of each page's block in the line, in reading order; -1 after its end."""
        ends = np.cumsum(sizes)
        steps = np.arange(max(sizes))[:, None]
        at = (ends - sizes)[None, :] + steps if way == "f" else ends[None, :] - 1 - steps
        return np.where(steps < np.array(sizes)[None, :], at, -1)

    def read(self, x: np.ndarray, sizes: list[int], way: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of all blocks in the line, and what training needs of each step."""
        layout = self.layout(sizes, way)
        gates_x = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        h, c = (np.zeros((len(sizes), HIDDEN), dtype=np.float32) for _ in range(2))
        states, kept = np.zeros((len(x), HIDDEN), dtype=np.float32), []
        for at in layout:
            live = at >= 0
            before = h, c
            z = gates_x[at] + h @ self.p[f"h{way}"]
            i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            c_new = f * c + i * g
            t = np.tanh(c_new)
            mask = live[:, None]
            h, c = np.where(mask, o * t, h), np.where(mask, c_new, c)
            states[at[live]] = h[live]
            if keep:
                kept.append((at, mask, before, i, f, o, g, t))
        return states, kept

    def scores(self, pages: Pages) -> np.ndarray:
        """Chance of every block to be main text."""
        if not sum(pages.sizes):
            return np.empty(0)
        sizes = [n for n in pages.sizes if n]
        x = self.inputs(pages)
        both = np.concatenate([self.read(x, sizes, way)[0] for way in "fb"], axis=1)
        return sigmoid(both @ self.p["out"] + self.p["bias"])[:, 0]

    def gradients(self, pages: Pages, labels: np.ndarray) -> dict[str, np.ndarray]:
        sizes = [n for n in pages.sizes if n]
        x = self.inputs(pages)
        read = {way: self.read(x, sizes, way, True) for way in "fb"}
        both = np.concatenate([read[way][0] for way in "fb"], axis=1)
        slope = ((sigmoid(both @ self.p["out"] + self.p["bias"])[:, 0] - labels) / len(labels)).astype(np.float32)[:, None]
        grads = {"out": both.T @ slope, "bias": slope.sum(axis=0)}
        d_both, d_x = slope @ self.p["out"].T, np.zeros_like(x)
        for n, way in enumerate("fb"):
            d_states = d_both[:, n * HIDDEN : (n + 1) * HIDDEN]
            d_gates = np.zeros((len(x), 4 * HIDDEN), dtype=np.float32)
            d_hidden = np.zeros((HIDDEN, 4 * HIDDEN), dtype=np.float32)
            d_h, d_c = (np.zeros((len(sizes), HIDDEN), dtype=np.float32) for _ in range(2))
            for at, mask, (h, c), i, f, o, g, t in reversed(read[way][1]):
                own_h = np.where(mask, d_h + d_states[at], 0)
                own_c = np.where(mask, d_c + own_h * o * (1 - t * t), 0)
                d_z = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * t * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
                d_hidden += h.T @ d_z
                live = mask[:, 0]
                d_gates[at[live]] = d_z[live]
                d_h, d_c = np.where(mask, d_z @ self.p[f"h{way}"].T, d_h), np.where(mask, own_c * f, d_c)
            grads |= {f"x{way}": x.T @ d_gates, f"h{way}": d_hidden, f"c{way}": d_gates.sum(axis=0)}
            d_x += d_gates @ self.p[f"x{way}"].T
        for name, bag, part in (("path", pages.path, d_x[:, :PATH_SIZE]), ("word", pages.word, d_x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / pages.counts)):
            places, starts = bag
            grads[name] = np.zeros_like(self.p[name])
            np.add.at(grads[name], places, np.repeat(part, np.diff(np.append(starts, len(places))), axis=0))
        return grads


def _word(draw: random.Random, parts: list[str]) -> str:
    return "".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))


def write_page(draw: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A generated page and its blocks' texts with labels (1: main text), in order."""
    parts = [draw.choice("bcdfglmnprstvz") + draw.choice("aeiouäéó") + draw.choice(["", "n", "r", "s", "th", "ß"]) for _ in range(24)]
    common = [_word(draw, parts) for _ in range(12)]
    labels: list[tuple[str, int]] = []
    out: list[str] = []

    def sentence(least: int, most: int) -> str:
        words = [draw.choice(common) if draw.random() < 0.4 else _word(draw, parts) for _ in range(draw.randint(least, most))]
        if draw.random() < 0.1:
            words = [w + draw.choice(["***", "%%%", "&&&", "!!", " |"]) for w in words]
        return " ".join(words).capitalize() + draw.choice([".", ".", ".", "", "?"])

    def prose(least: int, most: int) -> str:
        return " ".join(sentence(1, 18) for _ in range(draw.randint(least, most)))

    def names(options: list[str]) -> str:
        pick = draw.random()
        return "" if pick < 0.3 else f' class="{draw.choice(options)}{draw.choice(["", "", "-1", " wide", " clearfix"])}"' if pick < 0.75 else f' id="{draw.choice(options)}"'

    def put(markup: str, text: str, label: int) -> None:
        out.append(markup.format(html.escape(text, quote=False)))
        if line := " ".join(text.split()):
            labels.append((line, label))

    def menu(options: list[str], tag: str) -> None:
        out.append(f"<{tag}{names(options)}><ul>")
        for _ in range(draw.randint(2, 9)):
            word = sentence(1, 3)
            put(f'<li><a href="/{draw.randint(1, 99)}">{{}}</a></li>', word, 0)
        out.append(f"</ul></{tag}>")

    def notice() -> None:
        kind = draw.choice(["cookie-banner", "consent", "notice", "newsletter", "popup", "alert"])
        out.append(f'<div class="{kind}">')
        put("<p>{}</p>", draw.choice(["We use cookies to improve this site.", "Accept all cookies", "Subscribe to our newsletter", sentence(4, 12)]), 0)
        if draw.random() < 0.5:
            out.append('<form action="/s"><label>')
            put("{}", draw.choice(["Email address", "Your name", sentence(1, 3)]), 0)
            out.append('</label><input name="q"><button>OK</button></form>')
        out.append("</div>")

    def advert() -> None:
        tag = draw.choice(["div", "aside", "section"])
        kind = draw.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-box"])
        put(f'<{tag} class="{kind}">' + draw.choice(["{}", "<p>{}</p>", '<a href="/x">{}</a>']) + f"</{tag}>", prose(1, 4), 0)

    def side() -> None:
        tag, kind = draw.choice([("aside", ""), ("aside", ' class="sidebar"'), ("div", ' class="sidebar"'), ("div", ' id="sidebar"'), ("div", ' class="related"'), ("section", ' class="widget"'), ("div", ' class="share social"')])
        out.append(f"<{tag}{kind}>")
        put(draw.choice(["<h3>{}</h3>", "<h4>{}</h4>", "<p>{}</p>"]), sentence(1, 4), 0)
        for _ in range(draw.randint(0, 5)):
            put(draw.choice(['<li><a href="/r">{}</a></li>', "<p>{}</p>", '<p><a href="/r">{}</a></p>']), sentence(2, 14), 0)
        out.append(f"</{tag}>")

    def comments() -> None:
        tag, kind = draw.choice([("section", ' class="comments"'), ("div", ' id="comments"'), ("ol", ' class="commentlist"'), ("div", ' class="discussion replies"'), ("section", ' id="user-comments"')])
        inner = draw.choice(["div class=\"comment\"", "li class=\"comment\"", "article class=\"comment\"", "div class=\"reply\""])
        out.append(f"<{tag}{kind}>")
        put(draw.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<p>{}</p>"]), draw.choice(["Comments", "3 replies", sentence(1, 3)]), 0)
        for _ in range(draw.randint(1, 6)):
            out.append(f"<{inner}>")
            if draw.random() < 0.6:
                put(draw.choice(["<p><b>{}</b></p>", '<span class="author">{}</span>', "<h4>{}</h4>"]) if draw.random() < 0.7 else "<div>{}</div>", sentence(1, 2), 0)
                out.append("<div>" if (open_div := draw.random() < 0.5) else "<p></p>")
            else:
                open_div = False
            put("<p>{}</p>", prose(1, 3), 0)
            out.append(("</div>" if open_div else "") + f"</{inner.split()[0]}>")
        out.append(f"</{tag}>")

    def article() -> None:
        tag, kind = draw.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="content"'), ("div", ' class="article-body"'), ("div", ' class="entry"'), ("div", ' class="story text"'), ("section", ' class="article"')])
        outer = draw.random() < 0.3
        out.append(("<main>" if outer else "") + f"<{tag}{kind}>")
        if draw.random() < 0.9:
            head = draw.random() < 0.2
            put(("<header>" if head else "") + draw.choice(["<h1>{}</h1>", "<h1>{}</h1>", '<h1 class="title">{}</h1>', "<h2>{}</h2>"]) + ("</header>" if head else ""), sentence(1, 14), 1)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 4, 5, 6, 8, 12, 20])):
            kind = draw.random()
            if kind < 0.62:
                put("<p>{}</p>", prose(1, draw.choice([1, 2, 6])), 1)
            elif kind < 0.74:
                put("<p><b>{}<br>", prose(1, 3), 1)
                put("<p>{}</p>", prose(1, 3), 1)
            elif kind < 0.80:
                put(draw.choice(["<h2>{}</h2>", "<h3>{}</h3>"]), sentence(1, 8), 1)
            elif kind < 0.85:
                out.append("<ul>" if (plain := draw.random() < 0.6) else "<ol>")
                for _ in range(draw.randint(1, 5)):
                    put("<li>{}</li>", sentence(1, 14), 1)
                out.append("</ul>" if plain else "</ol>")
            elif kind < 0.88:
                put(draw.choice(["<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"]), prose(1, 2), 1)
            elif kind < 0.90:
                out.append("<table>")
                for _ in range(draw.randint(1, 3)):
                    out.append("<tr>")
                    for _ in range(2):
                        put("<td>{}</td>", sentence(1, 4), 1)
                    out.append("</tr>")
                out.append("</table>")
            elif kind < 0.93:
                put("<div>{}</div>", prose(1, 4), 1)
            elif kind < 0.95:
                put('<figure><img src="a.png"><figcaption>{}</figcaption></figure>', sentence(2, 10), 1)
            elif kind < 0.97:
                advert()
            elif kind < 0.985:
                side()
            else:
                notice()
        if draw.random() < 0.06:
            comments()
        out.append(f"</{tag}>" + ("</main>" if outer else ""))

    out.append(f"<!DOCTYPE html><html><head><title>{sentence(2, 8)}</title><style>p{{}}</style><script>var a=1</script></head><body>")
    wrap = draw.random() < 0.2
    out.append('<div class="page">' if wrap else "")
    if draw.random() < 0.3:
        notice()
    if draw.random() < 0.35:
        out.append(f"<header{names(['header', 'masthead', 'top'])}>")
        put(draw.choice(["<h1>{}</h1>", '<a href="/">{}</a>', "<p>{}</p>", "<div>{}</div>"]), sentence(1, 5), 0)
        if draw.random() < 0.5:
            menu(["nav", "menu"], "nav")
        out.append("</header>")
    if draw.random() < 0.7:
        if draw.random() < 0.7:
            menu(["nav", "menu", "main-nav", "navbar"], "nav")
        else:
            out.append('<div class="menu">')
            menu(["menu", "links"], "div")
            out.append("</div>")
    for part, chance in ((advert, 0.35), (side, 0.15)):
        if draw.random() < chance:
            part()
    article()
    for part, chance in ((comments, 0.25), (side, 0.25), (advert, 0.2), (notice, 0.1)):
        if draw.random() < chance:
            part()
    if draw.random() < 0.8:
        tag, kind = draw.choice([("footer", ""), ("footer", ' class="site-footer"'), ("div", ' class="footer"'), ("div", ' id="footer"')])
        out.append(f"<{tag}{kind}>")
        put(draw.choice(["{}", "<p>{}</p>", "<small>{}</small>"]), draw.choice(["© ", "Copyright ", ""]) + prose(1, 2), 0)
        out.append(f"</{tag}>")
    out.append("</div>" if wrap else "")
    out.append("</body></html>" if draw.random() < 0.9 else "")
    return "".join(out), labels


def align(own: list[Block], labels: list[tuple[str, int]]) -> np.ndarray | None:
    """Labels of the blocks, if the page was read into the blocks that were written."""
    return np.array([y for _, y in labels], dtype=np.float32) if [b.text for b in own] == [t for t, _ in labels] else None


@cache
def labeller(pages: int = PAGES, passes: int = PASSES, seed: int = SEED) -> Labeller:
    """Trained by Adam on generated pages; the same at every call."""
    draw, words, model = random.Random(seed), Words(), Labeller(seed)
    written = []
    while len(written) < pages:
        page, labels = write_page(draw)
        own = blocks(page)
        if own and (y := align(own, labels)) is not None:
            written.append((own, y))
    steps = [written[i : i + STEP_PAGES] for i in range(0, pages, STEP_PAGES)]
    ready = [(featurise([o for o, _ in step], words), np.concatenate([y for _, y in step])) for step in steps]
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for n in range(1, passes * len(ready) + 1):
        grads = model.gradients(*ready[draw.randrange(len(ready))])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.p[k] -= RATE * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
    return model


def runs(sizes: list[int]) -> Iterator[list[int]]:
    """Pages of about one length together, so that padded sequences hold CELLS blocks or are of a single page."""
    order, held = sorted(range(len(sizes)), key=lambda i: sizes[i]), []
    for i in order:
        if held and (len(held) + 1) * sizes[i] > CELLS:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def extract(pages: list[str | None], model: Labeller, words: Words) -> list[tuple[str, int, int]]:
    """For each page: main text, blocks, blocks kept."""
    read = [blocks(p or "") for p in pages]
    out: list[tuple[str, int, int]] = [("", 0, 0)] * len(pages)
    for group in runs([len(b) for b in read]):
        scores = model.scores(featurise([read[i] for i in group], words))
        at = 0
        for i in group:
            n = len(read[i])
            kept = [b.text for b, s in zip(read[i], scores[at : at + n], strict=True) if s >= 0.5]
            out[i] = "\n".join(kept), n, len(kept)
            at += n
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with text, n_chars, n_blocks and n_kept.

    Null, empty and blank pages, and pages without main text, have the empty text. Pages are read whole, however long
    and however broken their markup. Repeated rows are read alike; an empty table gives no rows. Other columns are
    ignored.
    """
    weights = labeller().p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = Labeller(), Words()
        model.p = weights
        for whole in batches:
            for batch in slices(whole, "html"):
                found = extract([None if x is None else x.decode("utf-8", "replace") for x in binary(batch.column("html"))], model, words)
                text = [x[0] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), *[pa.array([x[k] for x in found], pa.int64()) for k in (1, 2)]],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
