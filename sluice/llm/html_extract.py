"""Main text of web pages by a conditional random field over the page's blocks.

A page becomes the list of its leaf blocks, in order: the text between two borders of block
elements, with the tags, classes and roles of its ancestors. Each block has features of its
ancestors and of its text; a linear chain over the blocks scores neighbouring labels. The
weights are trained by gradient ascent on the likelihood of labelled pages, and Viterbi's
algorithm finds the best labels. The labelled pages are:

- ``LABELLED``, short pages in several layouts, with their main blocks marked;
- at most ``Training.pages`` pages of the table that mark their own main part by an
  ``article`` or ``main`` element, labelled by that element and what stands inside it.

Training is on that bounded sample, in one task; extraction is per row without a shuffle.
In a block character references are decoded and runs of white space become one space. A
line break element is white space.

Null and empty html gives an empty text, as does a page without a main block. Broken html
does not raise: open elements end with the page, an open comment hides the rest. Rows are
independent of each other; repeated rows get equal results; an empty table gives an empty
result. Other columns than id, url and html are not read. Long pages take time in proportion.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Training:
    pages: int = 300
    rounds: int = 60
    rate: float = 0.5
    penalty: float = 1e-4


#: Elements without content, elements whose content is no text of the page,
#: elements that begin a block, and what ends an open element of the same kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template noscript textarea svg math iframe object title select".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul button label".split()
)
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody"),
}
_FENCE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "menu"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>",
    re.DOTALL,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PIECES = re.compile(r"[a-z]+")
_MARK = "data-main"


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]
    leaf: str
    linked: int
    marked: bool


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    held: list[str] = []
    linked, anchor = 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                found.append(
                    Block(text, tuple(s[1] for s in stack), stack[-1][0] if stack else "", linked, any(s[2] for s in stack))
                )
            held.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        match = _TAG.search(page, at)
        stop = match.start() if match else size
        if stop > at:
            held.append(page[at:stop])
            if anchor:
                linked += stop - at
        if not match:
            break
        at = match.end()
        name = match.group(2) or match.group(5)
        if not name:
            continue
        name = name.lower()
        closing = bool(match.group(1) or match.group(4))
        if name == "a":
            anchor = not closing
        elif name == "br":
            held.append(" ")
        elif name in HIDDEN and not closing:
            if (match.group(3) or match.group(6) or "").endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif name in BLOCKS or name == "head":
            flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            ends = ENDS.get(name, ())
            while ends and stack and stack[-1][0] not in _FENCE:
                last = stack[-1][0]
                if last not in ends:
                    break
                stack.pop()
            if name not in VOID:
                stack.append(_element(name, match.group(3) or match.group(6) or ""))
    flush()
    return found


def _element(name: str, attributes: str) -> tuple[str, tuple[str, ...], bool]:
    marks = [f"t:{name}"]
    if "=" in attributes:
        for match in _NAMED.finditer(attributes):
            value = (match.group(2) or match.group(3) or match.group(4) or "").lower()
            marks += [f"c:{piece}" for piece in _PIECES.findall(value)]
    return name, tuple(marks), _MARK in attributes


def features(found: list[Block]) -> list[list[str]]:
    """What each block shows: its ancestors, its own element, and the look of its text."""
    out = []
    for block in found:
        own = {mark for marks in block.path for mark in marks}
        own.discard("t:html")
        own.discard("t:body")
        size = len(block.text)
        own |= {
            "bias",
            f"leaf:{block.leaf}",
            f"size:{min(8, int(math.log2(size + 1)))}",
            f"links:{round(4 * min(1.0, block.linked / size))}",
        }
        if block.text[-1] in ".!?":
            own.add("sentence")
        if "©" in block.text:
            own.add("copyright")
        out.append(sorted(own))
    return out


class Field:
    """The linear chain: weights per feature and label, and per pair of labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    def rows(self, pages: list[list[str]]) -> list[list[int]]:
        return [[self.names[x] for x in own if x in self.names] for own in pages]

    def best(self, found: list[Block]) -> list[int]:
        """The likeliest labels by Viterbi's algorithm; 1 is main text."""
        back = []
        score = None
        steps = self.steps.tolist()
        for row in self.rows(features(found)):
            own = self.weights[row].sum(0).tolist()
            if score is None:
                score = own
                continue
            fresh, came = [], []
            for label in (0, 1):
                through = [score[0] + steps[0][label], score[1] + steps[1][label]]
                source = 1 if through[1] > through[0] else 0
                came.append(source)
                fresh.append(through[source] + own[label])
            back.append(came)
            score = fresh
        if score is None:
            return []
        labels = [1 if score[1] > score[0] else 0]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]

    def dump(self) -> str:
        return json.dumps({"names": self.names, "weights": self.weights.tolist(), "steps": self.steps.tolist()})

    @classmethod
    def load(cls, text: str) -> "Field":
        parts = json.loads(text)
        return cls(parts["names"], np.array(parts["weights"]).reshape(-1, 2), np.array(parts["steps"]))


def train(pages: list[tuple[list[list[str]], list[int]]], rules: Training = Training()) -> Field:
    """Weights that maximise the likelihood of the labels, by adaptive gradient steps."""
    names = {x: i for i, x in enumerate(sorted({x for page, _ in pages for own in page for x in own}))}
    field = Field(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    packed = [(field.rows(page), np.array(labels)) for page, labels in pages if labels]
    seen, seen_steps = np.full(field.weights.shape, 1e-8), np.full((2, 2), 1e-8)
    random = np.random.default_rng(5)
    for _ in range(rules.rounds):
        order = random.permutation(len(packed))
        for low in range(0, len(order), 16):
            g, gs = np.zeros_like(field.weights), np.zeros((2, 2))
            some = order[low : low + 16]
            for i in some:
                _slope(field, *packed[i], g, gs)
            g = g / len(some) - rules.penalty * field.weights
            gs = gs / len(some) - rules.penalty * field.steps
            seen += g * g
            seen_steps += gs * gs
            field.weights += rules.rate * g / np.sqrt(seen)
            field.steps += rules.rate * gs / np.sqrt(seen_steps)
    return field


def _slope(field: Field, rows: list[list[int]], labels: np.ndarray, g: np.ndarray, gs: np.ndarray) -> None:
    """Adds observed minus expected counts of one page, by the forward-backward algorithm."""
    own = np.array([field.weights[row].sum(0) for row in rows])
    n, steps = len(rows), field.steps
    ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
    ahead[0] = own[0]
    for t in range(1, n):
        ahead[t] = own[t] + np.logaddexp(ahead[t - 1, 0] + steps[0], ahead[t - 1, 1] + steps[1])
    for t in range(n - 2, -1, -1):
        onward = own[t + 1] + behind[t + 1]
        behind[t] = np.logaddexp(steps[:, 0] + onward[0], steps[:, 1] + onward[1])
    total = np.logaddexp(*ahead[-1])
    share = np.exp(ahead + behind - total)
    for t, row in enumerate(rows):
        g[row] -= share[t]
        g[row, labels[t]] += 1
    for t in range(1, n):
        pair = ahead[t - 1][:, None] + steps + (own[t] + behind[t])[None, :] - total
        gs -= np.exp(pair)
        gs[labels[t - 1], labels[t]] += 1


#: What an article or main element may hold that is no main text.
_NEVER = {"t:nav", "t:header", "t:footer", "t:aside", "t:form", "t:menu", "t:dialog", "t:button", "t:label"}
_NEVER_CLASSES = {
    f"c:{x}" for x in "ad ads advert comment comments cookie footer menu nav newsletter notice promo related share sidebar social".split()
}


def own_labels(found: list[Block]) -> list[int] | None:
    """Labels by the page's own ``article`` or ``main`` element; none without one."""
    labels = []
    for block in found:
        marks = {mark for own in block.path for mark in own}
        inside = bool(marks & {"t:article", "t:main"})
        labels.append(int(inside and not marks & _NEVER and not marks & _NEVER_CLASSES))
    return labels if any(labels) else None


#: Labelled pages in several layouts: blocks below an element with ``data-main`` are main text.
LABELLED = [
    """<body><div id="header"><a href=/>Home</a> <a href=/n>News</a></div><div class="menu"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
    <div id="content"><h1 data-main>A day at the lake</h1><p data-main>We left early, and the water was still.</p><p data-main>By noon it was warm.</p>
    <div class="ad">Buy boats now.</div><p data-main>Late in the day we went home, tired but glad.</p></div>
    <div class="sidebar"><h3>Popular</h3><p>Ten lakes that you must see.</p></div><div class="comments"><h3>Comments</h3><p>Great story, thanks for it!</p></div>
    <div id="footer">Copyright 2020 The Lake Paper. All rights reserved.</div></body>""",
    """<body><header><h1><a href=/>Daily</a></h1><nav><a href=a>World</a><a href=b>Sport</a></nav></header><main><div class="notice cookie">We use cookies.</div>
    <section><h2 data-main>Bridge opens</h2><p data-main>The new bridge was opened on Monday after three years of work.</p>
    <ul><li data-main>It is long.</li><li data-main>It is wide.</li></ul><blockquote data-main>It took long enough, said one of the builders.</blockquote></section>
    <aside><p>More about bridges in our archive.</p></aside><form><label>Your mail</label><p>Subscribe to our letter.</p><button>Send</button></form></main>
    <section class="comments"><article><p>I crossed it today and it is fine.</p></article></section><footer><p>&copy; Daily</p><p>Imprint</p></footer></body>""",
    """<body><nav class="top"><ul><li><a href=x>Start</a></li><li><a href=y>About</a></li></ul></nav><article><header><p class="share">Share this</p></header>
    <h1 data-main>Bread</h1><p data-main>Flour, water, salt and time are all it takes.</p><table><tr><td data-main>Flour</td><td data-main>500 g</td></tr></table>
    <div class="related"><p>Read next: all about butter and jam.</p></div><p data-main>Bake it for an hour.</p><footer><p>Filed under food.</p></footer></article>
    <div class="newsletter"><form><p>Get our recipes by mail every week.</p></form></div><div id="comments"><p>My bread did not rise at all.</p></div></body>""",
    """<body><table><tr><td class="nav"><a href=1>Index</a><br><a href=2>Links</a></td><td><div class="post entry"><h2 data-main>On walking</h2>
    <p data-main>Walking is slow, and that is the point of it.</p><pre data-main>left right left</pre><p data-main>So walk.</p></div></td></tr></table>
    <div class="banner promo">Shoes, half price this week only.</div><div class="reply comment"><p>I walk every day, rain or shine.</p></div><address>Mail the webmaster</address></body>""",
    """<body><div role="navigation"><a href=1>Back</a></div><div role="main"><h1 data-main>Report</h1><div data-main>The numbers rose for the third year in a row.</div>
    <div data-main>Nobody knows why.</div><dl><dt data-main>Rise</dt><dd data-main>Four in a hundred.</dd></dl><div class="advert">Sponsored: cheap loans.</div></div>
    <div role="complementary"><p>Other reports of this year that may interest you.</p></div><div role="contentinfo">Terms and privacy</div></body>""",
    """<body><div class="cookie notice"><p>This site stores cookies. By going on you agree.</p></div><main><article><h1 data-main>Rain</h1>
    <p data-main>It rained.</p><p data-main>It rained again, and the river rose above its banks in the night.</p><figure><figcaption data-main>The river at dawn.</figcaption></figure>
    <section class="comments"><h2>Reader comments</h2><div class="comment"><p>Stay safe, everybody out there by the river!</p></div></section></article></main>
    <aside class="sidebar"><ul><li><a href=1>Weather</a></li></ul></aside><footer>All rights reserved.</footer></body>""",
]


def labelled_pages() -> list[tuple[list[list[str]], list[int]]]:
    made = []
    for page in LABELLED:
        found = blocks(page)
        made.append((features(found), [int(b.marked) for b in found]))
    return made


def learn(pages: DataFrame, rules: Training = Training()) -> str:
    """The field trained on ``LABELLED`` and on a bounded sample of the table, in one task."""
    rows = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    total = rows.count()
    share = min(1.0, rules.pages / max(1, total))
    draw = F.pmod(F.xxhash64("html", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < share).limit(2 * rules.pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                labels = own_labels(found)
                if labels:
                    own = features(found)
                    made[json.dumps([own, labels])] = (own, labels)
        chosen = [made[k] for k in sorted(made)]
        field = train(chosen + labelled_pages() * max(1, len(chosen) // 20), rules)
        yield pa.RecordBatch.from_arrays([pa.array([field.dump()])], ["field"])

    found = sample.coalesce(1).mapInArrow(run, "field string").collect()
    return found[0]["field"] if found else train(labelled_pages(), rules).dump()


def extract(pages: DataFrame, field: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field.load(shared.value)
        for batch in batches:
            texts = []
            for page in batch.column(2).to_pylist():
                found = blocks(page or "")
                texts.append("\n".join(b.text for b, main in zip(found, own.best(found)) if main))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame, rules: Training = Training()) -> DataFrame:
    return extract(pages, learn(pages, rules))
