"""Main text of web pages by a linear-chain conditional random field.

A page is a chain of leaf blocks, the runs of text between block tags. Each
block has binary features of its ancestors (tags, words of class and id) and of
its text; a block's label (main text or not) depends on them and on the label
before it. Weights are trained on labelled pages, a page is decoded by Viterbi.

The labelled pages are made here, by a seeded writer of page layouts that labels
each block as it writes it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I,
)
#: Elements left out up to their end tag; without one, only the tag is (fixed values).
SKIPPED = {name: re.compile(rf"</{name}\s*>", re.I) for name in "noscript template iframe svg select object audio video canvas".split()}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")

#: Tags inside a line of text; all others begin and end blocks (fixed values).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that the start of another one closes (fixed values).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in its order; without scripts, styles, comments, other raw elements and the head's title."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    unclosed: set[str] = set()
    links = linked = 0

    def close() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), tuple(n for _, ns in stack for n in ns), linked))
        linked = 0

    at = 0
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            begin = len(page)
        if begin > at:
            held.append(page[at:begin])
            if links:
                linked += begin - at
        if begin == len(page):
            break
        token = _TOKEN.match(page, begin)
        if token is None:
            held.append("<")
            at = begin + 1
            continue
        at = max(token.end(), begin + 1)
        name = token["name"]
        if not name:
            continue
        name = name.lower()
        if name in SKIPPED and name not in unclosed and not token["end"] and not (name == "svg" and token["rest"].endswith("/")):
            last = SKIPPED[name].search(page, at)
            if last:
                at = last.end()
                continue
            unclosed.add(name)
        if name in INLINE:
            if name == "br":
                held.append("\n")
            elif name == "a":
                links = max(0, links - 1) if token["end"] else links + 1
            continue
        close()
        links = 0
        if token["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            continue
        if name in VOID:
            continue
        while stack and (stack[-1][0] in CLOSES.get(name, ()) or (name in _P_ENDS and stack[-1][0] == "p")):
            stack.pop()
        words = ()
        if token["rest"]:
            words = tuple(w.lower() for m in _NAMED.finditer(token["rest"]) for w in _WORD.findall(m[1] or m[2] or m[3] or ""))
        if not token["rest"].endswith("/"):
            stack.append((name, words))
    close()
    return out


def features_of(block: Block, place: int, count: int) -> list[str]:
    """Names of the features that a block has."""
    words = block.text.count(" ") + 1
    found = [f"t:{t}" for t in set(block.tags) - {"html", "body"}]
    found += [f"n:{n}" for n in set(block.names)]
    found.append(f"own:{block.tags[-1] if block.tags else ''}")
    found.append(f"len:{min(7, words.bit_length())}")
    share = block.linked / max(1, len(block.text))
    found.append(f"link:{0 if share < 0.05 else 1 if share < 0.5 else 2}")
    found.append(f"end:{'s' if block.text[-1] in '.!?:;…\"”»' else 'n'}")
    if "©" in block.text or "(c)" in block.text.lower():
        found.append("copyright")
    if place == 0:
        found.append("first")
    if place == count - 1:
        found.append("last")
    found.append("bias")
    return found


@dataclass(frozen=True)
class Field:
    """Weights of the two labels for each feature, of label pairs, and of a first label."""

    weights: dict[str, tuple[float, float]]
    pairs: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi); ties go to main text."""
        n = len(blocks)
        if not n:
            return []
        (p00, p01), (p10, p11) = self.pairs
        get, none = self.weights.get, (0.0, 0.0)
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, block in enumerate(blocks):
            x = y = 0.0
            for name in features_of(block, i, n):
                u, v = get(name, none)
                x += u
                y += v
            if i:
                from0 = 1 if b + p10 >= a + p00 else 0
                from1 = 1 if b + p11 >= a + p01 else 0
                back.append((from0, from1))
                a, b = max(a + p00, b + p10) + x, max(a + p01, b + p11) + y
            else:
                a, b = x, y
        label = 1 if b >= a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def trained(pages: list[tuple[str, list[int]]], rounds: int = 150, ridge: float = 0.02, rate: float = 0.5) -> Field:
    """A field fitted to labelled pages by gradient ascent (forward-backward, adaptive steps)."""
    number: dict[str, int] = {}
    chains = []
    for page, labels in pages:
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
        rows = [[number.setdefault(f, len(number)) for f in features_of(b, i, len(blocks))] for i, b in enumerate(blocks)]
        if rows:
            chains.append((rows, np.array(labels)))
    size = max(len(r) for r, _ in chains)
    width = max(len(x) for r, _ in chains for x in r)
    index = np.full((len(chains), size, width), len(number))
    truth = np.zeros((len(chains), size), np.int64)
    inside = np.zeros((len(chains), size), bool)
    for c, (rows, labels) in enumerate(chains):
        inside[c, : len(rows)] = True
        truth[c, : len(rows)] = labels
        for i, row in enumerate(rows):
            index[c, i, : len(row)] = row
    w, pairs = np.zeros((len(number) + 1, 2)), np.zeros((2, 2))
    seen_w, seen_p = np.full_like(w, 1e-3), np.full_like(pairs, 1e-3)
    hot = np.eye(2)[truth] * inside[..., None]
    for _ in range(rounds):
        emit = w[index].sum(axis=2) * inside[..., None]
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for i in range(1, size):
            step = np.logaddexp.reduce(alpha[:, i - 1, :, None] + pairs, axis=1) + emit[:, i]
            alpha[:, i] = np.where(inside[:, i, None], step, alpha[:, i - 1])
        for i in range(size - 2, -1, -1):
            step = np.logaddexp.reduce(pairs + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where(inside[:, i + 1, None], step, 0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        one = np.exp(alpha + beta - total[:, None, None]) * inside[..., None]
        grad_w = np.zeros_like(w)
        gap = (hot - one)[:, :, None, :]
        np.add.at(grad_w, index, np.broadcast_to(gap, (*index.shape, 2)))
        both = inside[:, 1:, None, None]
        two = np.exp(alpha[:, :-1, :, None] + pairs + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * both
        real = hot[:, :-1, :, None] * hot[:, 1:, None, :]
        grad_p = (real - two).sum(axis=(0, 1))
        grad_w[-1] = 0
        grad_w, grad_p = grad_w / len(chains) - ridge * w / 10, grad_p / len(chains) - ridge * pairs / 10
        seen_w += grad_w**2
        seen_p += grad_p**2
        w += rate * grad_w / np.sqrt(seen_w)
        pairs += rate * grad_p / np.sqrt(seen_p)
    weights = {name: (float(w[k, 0]), float(w[k, 1])) for name, k in number.items()}
    return Field(weights, ((float(pairs[0, 0]), float(pairs[0, 1])), (float(pairs[1, 0]), float(pairs[1, 1]))))


class _Writer:
    """Writes one page of random words, labelling each block."""

    def __init__(self, seed: int):
        self.random = np.random.default_rng([20_240_503, seed])
        self.parts: list[str] = []
        self.labels: list[int] = []

    def pick(self, *choices: str) -> str:
        return choices[int(self.random.integers(len(choices)))]

    def words(self, low: int, high: int, end: str = "") -> str:
        letters = np.array(list("aeiourstlnmdéü"))
        n = int(self.random.integers(low, high + 1))
        made = ["".join(self.random.choice(letters, int(self.random.integers(2, 9)))) for _ in range(n)]
        return " ".join(made).capitalize() + end

    def block(self, label: int, tag: str, text: str, close: bool = True) -> None:
        self.parts.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        self.labels.append(label)

    def list_of_links(self, holder: str) -> None:
        self.parts.append(f"<{holder}><ul>")
        for _ in range(int(self.random.integers(2, 8))):
            self.block(0, "li", f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>')
        self.parts.append(f"</ul></{holder.split()[0]}>")

    def note(self, holder: str) -> None:
        """A short or long text that is no main text, in one of the holders' forms."""
        text = self.words(3, 30, self.pick(".", "", ".", "!"))
        if self.random.random() < 0.5:
            self.parts.append(f"<{holder}>{text}</{holder.split()[0]}>")
            self.labels.append(0)
            return
        self.parts.append(f"<{holder}>")
        for _ in range(int(self.random.integers(1, 4))):
            self.block(0, self.pick("p", "p", "h3", "div"), self.words(2, 25, self.pick(".", "")))
        self.parts.append(f"</{holder.split()[0]}>")

    def form(self) -> None:
        self.parts.append(self.pick("<form>", '<form class="search">', '<form id="newsletter">'))
        self.block(0, "p", f"<label>{self.words(1, 3)}</label><input name=x>")
        if self.random.random() < 0.5:
            self.block(0, "button", self.words(1, 2))
        self.parts.append("</form>")

    def comments(self) -> None:
        holder = self.pick('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="reader-comments"')
        self.parts.append(f"<{holder}>")
        if self.random.random() < 0.6:
            self.block(0, "h2", self.words(1, 3))
        for _ in range(int(self.random.integers(1, 5))):
            one = self.pick("article", 'div class="comment"', "div", 'article class="comment"')
            self.parts.append(f"<{one}>")
            if self.random.random() < 0.4:
                self.block(0, self.pick("h4", "div class=author"), self.words(1, 3))
            self.block(0, "p", self.words(3, 50, "."))
            self.parts.append(f"</{one.split()[0]}>")
        self.parts.append(f"</{holder.split()[0]}>")

    def aside(self) -> None:
        kind = int(self.random.integers(7))
        if kind == 0:
            self.list_of_links(self.pick("nav", 'div class="menu"', 'div id="navigation"', 'aside class="related"', 'div class="breadcrumb"'))
        elif kind == 1:
            self.note(self.pick('div class="ad"', 'div class="advert"', 'aside class="ads"', 'div id="ad-top"', 'div class="sponsored"', 'div class="promo banner"'))
        elif kind == 2:
            self.note(self.pick('div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div role="alert"', 'div class="consent"'))
        elif kind == 3:
            self.form()
        elif kind == 4:
            self.note(self.pick("aside", 'aside class="sidebar"', 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"'))
        elif kind == 5:
            self.note(self.pick('div class="share"', 'div class="social"', 'div class="newsletter"', 'div class="subscribe"', 'div class="popup"'))
        else:
            self.note(self.pick("header", 'div class="header"', 'div id="masthead"'))

    def main(self) -> None:
        holder = self.pick("article", "article", "article", "main", 'div class="content"', 'div id="article"', 'div class="post-body"', 'article class="post"')
        self.parts.append(f"<{holder}>")
        if self.random.random() < 0.85:
            self.block(1, self.pick("h1", "h1", "h2"), self.words(1, 14, self.pick("", "", ".")))
        for _ in range(int(self.random.integers(1, 14))):
            kind = self.random.random()
            text = self.words(1, 6, ".") if self.random.random() < 0.25 else self.words(8, 70, ".")
            if kind < 0.7:
                self.block(1, "p", text, self.random.random() < 0.8)
            elif kind < 0.78:
                self.block(1, "p", f"<b>{text}<br>", False)
            elif kind < 0.84:
                self.block(1, self.pick("h2", "h3"), self.words(1, 8))
            elif kind < 0.9:
                self.parts.append("<ul>")
                for _ in range(int(self.random.integers(1, 4))):
                    self.block(1, "li", self.words(2, 20, self.pick("", ".")))
                self.parts.append("</ul>")
            elif kind < 0.94:
                self.block(1, self.pick("blockquote", "pre"), text)
            elif kind < 0.97:
                self.block(1, "p", f'{self.words(3, 20)} <a href="/x">{self.words(1, 3)}</a> {self.words(2, 10, ".")}')
            else:
                self.aside()
        self.parts.append(f"</{holder.split()[0]}>")

    def page(self) -> tuple[str, list[int]]:
        self.parts.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        if self.random.random() < 0.8:
            self.list_of_links(self.pick("nav", "nav", "header", 'div class="nav"'))
        for _ in range(int(self.random.integers(0, 3))):
            self.aside()
        self.main()
        if self.random.random() < 0.35:
            self.comments()
        for _ in range(int(self.random.integers(0, 2))):
            self.aside()
        if self.random.random() < 0.85:
            text = f"&copy; {self.words(1, 2)} &middot; {self.words(2, 12, '.')}" if self.random.random() < 0.6 else self.words(3, 20, ".")
            self.parts.append(f"<footer>{text}</footer>" if self.random.random() < 0.7 else f'<div class="footer">{text}</div>')
            self.labels.append(0)
        if self.random.random() < 0.9:
            self.parts.append("</body></html>")
        return "".join(self.parts), self.labels


def labelled_pages(count: int = 400) -> list[tuple[str, list[int]]]:
    """Pages and the labels of their blocks."""
    return [_Writer(seed).page() for seed in range(count)]


@lru_cache(1)
def default_field() -> Field:
    return trained(labelled_pages())


def main_text(page: str | None, field: Field) -> str:
    """The main blocks in the page's order, joined by line feeds."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, label in zip(blocks, field.labels(blocks)) if label)


def _extractor(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = [main_text(page, field) for page in batch.column("html").to_pylist()]
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "html"]
            names = [n for n in batch.schema.names if n != "html"]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), lengths], names=[*names, "text", "n_chars"])

    return extract


def extracted(pages: DataFrame, field: Field | None = None, page: str = "html") -> DataFrame:
    """``pages`` without the page's source, with its main ``text`` and ``n_chars``; clashing columns are replaced.

    A null or empty page, and one without main text, has an empty text. Broken and
    unclosed markup is read as far as it goes. Every row comes back, repeats
    included; there is no shuffle.
    """
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    rows = pages.select(*kept, F.col(page).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "html")
    return rows.mapInArrow(_extractor(shared), f"{shape}text string, n_chars long")


def op1_html_extraction(spark, folder: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"))
