import random
import zlib

import numpy as np

from sluice.llm import language_id
from llm.conftest import ODD

SOUNDS = {"aa": "ba da ga ma na", "bb": "ti ki pi si li", "cc": "shö thö mön röl"}


def prose(lang, seed, size=60):
    draw = random.Random(seed)
    parts = SOUNDS[lang].split()
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(size))


def labelled(spark, count=300):
    rows = [(n, prose(lang := list(SOUNDS)[n % 3], n), lang) for n in range(count)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_calibration(spark):
    rows, docs = labelled(spark)
    found = {r["doc_id"]: r for r in language_id.language_report(docs).collect()}
    assert len(found) == len(rows)
    held = [(n, lang) for n, _, lang in rows if zlib.crc32(str(n).encode()) % 5 == 0]
    assert all(found[n]["held_out"] == (zlib.crc32(str(n).encode()) % 5 == 0) for n, _, _ in rows)
    assert np.mean([found[n]["lang_pred"] == lang for n, lang in held]) > 0.97
    assert np.mean([found[n]["score"] for n, _ in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows, docs = labelled(spark, 120)
    turned = [(n, t, "zz" if zlib.crc32(str(n).encode()) % 5 == 0 else lang) for n, t, lang in rows]
    other = spark.createDataFrame(turned, "doc_id long, text string, lang string")
    assert language_id.learn(docs) == language_id.learn(other)


def test_und_nulls_and_no_rows(spark):
    rows, _ = labelled(spark, 90)
    rows += [(1000 + n, t, None if n % 2 else "aa") for n, t in enumerate([*ODD, "123 !!"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS held_out")
    found = {r["doc_id"]: r for r in language_id.language_report(docs).collect()}
    for n, text in enumerate([*ODD, "123 !!"]):
        row = found[1000 + n]
        if text is None or not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] in SOUNDS
    assert language_id.language_report(docs.limit(0)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r["lang_pred"] for r in language_id.language_report(unlabelled).collect()} == {"und"}


def test_grams_and_slices(monkeypatch):
    grams = language_id.Grams()
    found, whose, lettered = grams(["Ab  c", "", "1!", "ab c"])
    assert lettered.tolist() == [True, False, False, True]
    assert sorted(found[whose == 0]) == sorted(found[whose == 3])
    weights = np.random.default_rng(1).normal(size=(language_id.DIMENSIONS, 2))
    model = language_id.Model(["a", "b"], weights, np.zeros(2), 1.0)
    whole, _ = model.logits(["ab " * 300, "c"], grams)
    monkeypatch.setattr(language_id, "_SLICE", 30)
    parts, _ = model.logits(["ab " * 300, "c"], grams)
    assert np.abs(whole - parts).max() < 0.5


def test_penalties_leave_few_weights(spark):
    _, docs = labelled(spark)
    model = language_id.Model.load(language_id.learn(docs))
    assert 0 < model.weights.any(1).sum() < 2000
    assert 0.05 <= model.temperature <= 20


def test_all_of_many_languages_are_learned(spark):
    """The bound on rows is shared out, so it leaves none out, however rows are ordered."""
    draw = random.Random(5)
    letters = [chr(c) for c in range(0x0430, 0x0450)]
    alphabets = {f"l{n:02d}": draw.sample(letters, 6) for n in range(30)}
    rows = []
    for lang, own in alphabets.items():
        for _ in range(40):
            text = " ".join("".join(draw.choice(own) for _ in range(4)) for _ in range(40))
            rows.append((len(rows), text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rules = language_id.Training(per_language=1000, most_rows=600)
    assert rules.rows_of_each(30) == 20 and rules.rows_of_each(2) == 300
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.language_report(docs, rules).collect()}
    assert set(found.values()) == set(alphabets)
    held = [(n, lang) for n, _, lang in rows if zlib.crc32(str(n).encode()) % 5 == 0]
    assert np.mean([found[n] == lang for n, lang in held]) > 0.9
