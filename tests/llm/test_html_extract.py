import itertools
import random

import numpy as np
import pytest

from sluice.llm import html_extract as he
from llm.conftest import sentence

SCHEMA = "page_id long, url string, html string"


def page(n, layout="article"):
    draw = random.Random(n)
    body = [sentence(n * 10 + k, draw.randrange(1, 40)) for k in range(draw.randrange(1, 9))]
    body[0] += " &amp; &lt;b&gt; &eacute;&#233; &copy;"
    paragraphs = "".join(f"<p>{x} <b>bold</b>\n <i>x</i>\n" for x in body)
    main = [f"{x} bold x" for x in body]
    main[0] = main[0].replace("&amp; &lt;b&gt; &eacute;&#233; &copy;", "& <b> éé ©")
    side = f"<nav><ul><li><a href=1>{sentence(n + 1, 1)}</a><li><a>{sentence(n + 2, 1)}</a></ul></nav><!-- x --><div class='ad'>{sentence(n + 3, 9)}.</div>"
    tail = f"<div class=comments><p>{sentence(n + 4, 12)}.</p></div><aside><p>{sentence(n + 5, 30)}</p></aside><form><p>Send</p><textarea>t</textarea></form><footer>&copy; {sentence(n + 6, 3)}</footer>"
    head = f"<html><head><title>T {n}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
    if layout == "article":
        return f"{head}{side}<article><h1>Title {n}</h1>{paragraphs}</article>{tail}</body></html>", "\n".join([f"Title {n}", *main])
    return f'{head}{side}<div id="content"><h1>Title {n}</h1>{paragraphs}</div>{tail}</body></html>', "\n".join([f"Title {n}", *main])


def test_pages(spark):
    made = {n: page(n) for n in range(80)}
    rows = [(n, f"u{n}", html) for n, (html, _) in made.items()]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS text", "2 AS n_chars")
    found = {r["page_id"]: r for r in he.main_text(docs).collect()}
    for n, (_, text) in made.items():
        assert found[n]["text"] == text and found[n]["n_chars"] == len(text) and found[n]["url"] == f"u{n}"


def test_other_layouts_by_the_labelled_pages(spark):
    field = he.Field.load(he.train(he.labelled_pages()).dump())
    right = total = 0
    for made, labels in he.labelled_pages():
        pass
    for source in he.LABELLED:
        found = he.blocks(source)
        got = field.best(found)
        right += sum(int(b.marked) == label for b, label in zip(found, got))
        total += len(found)
    assert right / total > 0.97
    # Held out: each page by a field that has not seen it.
    pages = he.labelled_pages()
    scores = []
    for n in range(len(pages)):
        own = he.train(pages[:n] + pages[n + 1 :])
        found = he.blocks(he.LABELLED[n])
        scores += [int(b.marked) == label for b, label in zip(found, own.best(found))]
    assert np.mean(scores) > 0.6
    for n in range(10):
        html, text = page(n, "content")
        found = he.blocks(html)
        kept = "\n".join(b.text for b, label in zip(found, field.best(found)) if label)
        assert kept == text


def test_odd_pages(spark):
    odd = [
        None, "", "   ", "plain text", "<p>a<p>b", "<!-- open <p>x", "<script>x", "<p", "<<>>", "</p></div>", "&amp", "<p title='>'>q",
        "<article><p>one<br>two&nbsp; three</p><p>four", "<article>" + "<div>" * 3000 + "deep", "<a>" * 2000 + "x", "<p title=\"" * 200,
    ]
    docs = spark.createDataFrame([(n, None, h) for n, h in enumerate(odd)] + [(0, "u", None)] * 2, SCHEMA)
    rows = he.main_text(docs).collect()
    assert len(rows) == len(odd) + 2 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in rows)
    by_id = {r["page_id"]: r["text"] for r in rows}
    assert by_id[0] == "" and by_id[1] == "" and by_id[12] == "one two three\nfour"
    assert he.main_text(docs.limit(0)).count() == 0


def test_viterbi_and_slope_equal_enumeration():
    random_state = np.random.default_rng(3)
    names = {"a": 0, "b": 1, "c": 2}
    field = he.Field(names, random_state.normal(size=(3, 2)), random_state.normal(size=(2, 2)))
    rows = [[0], [1, 2], [0, 2], [1], []]

    def score(labels):
        own = sum(field.weights[row, k].sum() for row, k in zip(rows, labels))
        return own + sum(field.steps[a, b] for a, b in zip(labels, labels[1:]))

    every = list(itertools.product((0, 1), repeat=len(rows)))
    found = he.Field(names, field.weights, field.steps)
    found.rows = lambda pages: rows
    blocks = [he.Block("x", (), "p", 0, False)] * len(rows)
    assert tuple(found.best(blocks)) == max(every, key=score)
    total = np.logaddexp.reduce([score(x) for x in every])
    labels = np.array([0, 1, 1, 0, 1])
    g, gs = np.zeros((3, 2)), np.zeros((2, 2))
    he._slope(field, rows, labels, g, gs)
    want, steps = np.zeros((3, 2)), np.zeros((2, 2))
    for path in every:
        share = np.exp(score(path) - total)
        for sign, own in ((-share, path),) + (((1.0, tuple(labels)),) if path == every[0] else ()):
            for row, k in zip(rows, own):
                want[row, k] += sign
            for a, b in zip(own, own[1:]):
                steps[a, b] += sign
    assert np.allclose(g, want) and np.allclose(gs, steps)


@pytest.mark.parametrize("source, texts", [
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<p>x <b>y</b>z</p> t <h2>h</h2>", ["x yz", "t", "h"]),
    ("<SCRIPT>no</Script ><P>A&#x41;</P>", ["AA"]),
])
def test_blocks(source, texts):
    assert [b.text for b in he.blocks(source)] == texts
