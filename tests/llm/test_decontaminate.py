import hashlib
import re

import pytest

from sluice.llm import decontaminate
from llm.conftest import ODD, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for text in texts:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own is not None:
                    hit.update(range(i, i + size))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def rows(frame):
    return {(r["doc_id"], r["n_words"]): tuple(r)[1:] for r in frame.collect()}


ITEMS = [
    (1, sentence(1, 25)), (2, sentence(2, 10)), (30, "Short ITEM here"), (4, None), (5, ""), (6, "one"),
    (7, sentence(1, 25)), (None, sentence(8, 12)), (9, sentence(9, 9)), (10, "ÉCOLE, école; No-1"),
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def texts():
    first, second = sentence(1, 25).split(), sentence(2, 10)
    return [
        *ODD,
        sentence(50, 200),
        sentence(51, 80) + " " + sentence(1, 25).upper() + "! " + sentence(52, 80),
        " ".join(first[5:15]) + " " + sentence(53, 9) + "," + second,
        " ".join(first[5:14]),  # a word short of a window
        second + "\n" + second,
        "a short, item HERE and one more",
        sentence(8, 12) + " " + sentence(9, 9),
        "École, école; no - 1",
        sentence(60, 3000) + " " + " ".join(first[2:13]) + " " + sentence(61, 3000),
        " ".join(first + first),
    ]


def test_equals_brute_force(spark, make_docs, benchmark):
    docs = make_docs(texts()).selectExpr("*", "1 AS words", "2 AS text_hash")
    found = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.decontamination_report(docs, benchmark).collect()}
    for n, row in enumerate(brute(texts(), ITEMS)):
        assert found[n] == row, texts()[n]


def test_every_shared_span_is_found(spark, make_docs):
    """Wherever a span of a window's length stands, it is hit; one word less is not."""
    item = sentence(5, 40).split()
    spans = [item[i : i + 10] for i in range(31)] + [item[i : i + 9] for i in range(32)]
    docs = make_docs([sentence(100 + n, n % 17, 10**6) + " " + " ".join(s) + " " + sentence(900 + n, 5, 10**6) for n, s in enumerate(spans)])
    bench = docs.sparkSession.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r["doc_id"]: r["n_hit"] for r in decontaminate.decontamination_report(docs, bench).collect()}
    assert all(found[n] == (10 if n < 31 else 0) for n in found)


def test_empty_tables_repeated_rows_and_null_ids(spark, make_docs, benchmark):
    docs = make_docs([sentence(1, 25), sentence(1, 25), "other text", sentence(2, 10)], [3, 3, 3, None])
    found = sorted(((r["doc_id"] or -1), r["n_hit"]) for r in decontaminate.decontamination_report(docs, benchmark).collect())
    assert found == [(-1, 10), (3, 0), (3, 25), (3, 25)]
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert [tuple(r) for r in left.collect()] == [(3, "other text", "en", "s", 10)]
    assert decontaminate.decontamination_report(docs.limit(0), benchmark).count() == 0
    clean = decontaminate.decontamination_report(docs, benchmark.limit(0)).collect()
    assert len(clean) == 4 and not any(r["contaminated"] for r in clean)
