import hashlib
import random

import numpy as np
import pytest
import regex

from sluice.llm import fill_in_middle as fim
from llm.conftest import ODD, sentence

MARKED = ["a<P>b", "<S>", "x <M", "<<P", "P><S", "<", "é" * 3000, "日本語 " * 900, "\U0001f600" * 700 + "z", "é" * 800]
WORDS = r"\S+\s*"


def brute(text, doc_id, rules=fim.Rules()):
    """The contract on plain strings."""
    text = text or ""
    units = list(text)
    if rules.unit:
        starts = [m.start() for m in regex.finditer(rules.unit, text)]
        starts = [0, *starts[1:]] if text else []
        units = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    digest = hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in rules.sentinels) or h[2] % 100 >= rules.percent:
        return n, "plain", None, None, text
    if h[3] % 100 < rules.spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", [None, WORDS])
def test_equals_brute_force_and_restores(spark, make_docs, unit):
    rules = fim.Rules(unit=unit)
    texts = [*ODD, *MARKED, *(sentence(n, n * 7) for n in range(120))]
    docs = make_docs(texts, [n * 31 for n in range(len(texts))])
    made = fim.fill_in_middle(docs, rules)
    rows = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restore(made.output, made.form).alias("back"))
    forms = set()
    for row in rows.collect():
        text = texts[row["doc_id"] // 31]
        assert tuple(row)[1:6] == brute(text, row["doc_id"], rules)
        assert row["back"] == (text or "")
        forms.add(row["form"])
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1024])
def test_every_cut_of_a_text_in_any_blocks(block):
    text = "aé日\U0001f600 b  cdé\n" * 9
    data = np.frombuffer(text.encode(), np.uint8)
    tree = fim.BlockTree(data, None, block)
    assert [tree.cut(u) for u in range(len(text) + 1)] == [(len(text[:u].encode()), u) for u in range(len(text) + 1)]
    words = fim.BlockTree(data, regex.compile(WORDS), block)
    starts = [m.start() for m in regex.finditer(WORDS, text)]
    places = [(len(text[:a].encode()), a) for a in [*starts, len(text)]]
    assert [words.cut(u) for u in range(words.n_units + 1)] == places


def test_digests_repeats_null_ids_and_clashing_columns(spark, make_docs):
    docs = make_docs(["one two three"] * 3 + [None, "x"], [4, 4, None, 7, None])
    report = fim.fim_report(docs).collect()
    assert len(report) == 5
    for row in report:
        text = {4: "one two three", 7: ""}.get(row["doc_id"], "x" if row["n"] == 1 else "one two three")
        n, form, before, middle, output = brute(text, row["doc_id"])
        assert tuple(row)[1:5] == (n, form, before, middle)
        assert row["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert row["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    clashing = docs.selectExpr("doc_id", "text", "1 AS N", "2 AS output", "3 AS body", "4 AS id")
    made = fim.fill_in_middle(clashing)
    assert made.columns == ["doc_id", "body", "id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {(r["body"], r["id"]) for r in made.collect()} == {(3, 4)}
    assert fim.fim_report(docs.limit(0)).collect() == []


def test_sentinels_that_could_be_mistaken_are_refused():
    for marks in (("<P<", "<S>", "<M>"), ("P>", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P", "<Px", "<M>"), ("<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Rules(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_a_very_long_text():
    draw = random.Random(3)
    text = "".join(draw.choice("ab é日\n") for _ in range(2_000_000))
    n, form, before, middle, output = fim.transform(text.encode(), 12, fim.Rules(), None)
    assert (n, form, before, middle, output.decode()) == brute(text, 12)
