"""The registered queries against brute force over the smallest tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_points
from compare import compare, connect
from sluice.llm import bpe, queries, sql
from llm.test_setsketch import brute as brute_groups

FOLDER = "/root/testdata/sf0.001"
QUERIES = queries.registered()


@pytest.fixture(scope="module")
def tables(spark):
    return {
        name: spark.read.parquet(f"{FOLDER}/{name}.parquet").collect() for name in ("documents", "pages", "benchmark")
    }


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert set(sql.statements()) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(sql.statements()))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), sql.statements()[name]) is None


def test_languages(spark, tables):
    rows = run(spark, "op2_language_id")
    lang = {r["doc_id"]: r["lang"] for r in tables["documents"]}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean(held) > 0.9


def test_token_places(spark, tables):
    own = bpe.Encoder(queries.tokenizer_path())
    start = 0
    rows = {r["doc_id"]: r for r in run(spark, "op3_token_store")}
    for doc in sorted(tables["documents"], key=lambda r: r["doc_id"]):
        ids = own.tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(rows[doc["doc_id"]]) == (doc["doc_id"], start, len(ids), crc)
        start += len(ids)


def test_near_duplicates(spark, tables):
    docs = tables["documents"]
    rows = {r["doc_id"]: tuple(r) for r in run(spark, "op6_near_duplicates")}
    for doc, size, group in brute_groups([r["text"] for r in docs], [r["doc_id"] for r in docs], 3, 85):
        assert rows[doc] == (doc, size, group, doc == group)


def test_pages(spark, tables):
    first = {}
    for page in tables["pages"]:
        text = page["html"] or ""
        first[text] = min(first.get(text, page["page_id"]), page["page_id"])
    rows = {r["page_id"]: tuple(r) for r in run(spark, "op7_warc_packages")}
    assert len(rows) == len(tables["pages"])
    for page in tables["pages"]:
        data, head = (page["html"] or "").encode(), first[page["html"] or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = head != page["page_id"]
        want = (page["page_id"], len(data), digest, "revisit" if revisit else "response", head if revisit else None)
        assert rows[page["page_id"]] == want


def test_round_trip(spark, tables):
    own = bpe.Encoder(queries.tokenizer_path())
    rows = {r["doc_id"]: r for r in run(spark, "op9_bpe_round_trip")}
    for doc in tables["documents"]:
        ids = own.tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


def test_personal_data_is_gone(spark, tables):
    found = re.compile(r"[\w.]+@\w+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b4\d{15}\b|AKIA[A-Z2-7]{16}|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    rows = {r["doc_id"]: r["text"] for r in run(spark, "op5_pii")}
    values = 0
    for doc in tables["documents"]:
        for value in found.findall(doc["text"] or ""):
            values += 1
            assert value not in rows[doc["doc_id"]]
    assert values > 0


def test_articles(spark, tables):
    """The pages mark their article: its blocks, by cutting the page with patterns."""
    import html

    rows = {r["page_id"]: r for r in run(spark, "op10_html_text")}
    for page in tables["pages"]:
        match = re.search(r"<article>(.*)</article>", page["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>|<br>", match[1]) if match else []
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert rows[page["page_id"]]["text"] == "\n".join(t for t in texts if t)


def test_every_stage_reads_all_documents(spark, tables):
    assert len(run(spark, "op8_quality_rules")) == len(run(spark, "op4_line_dedup")) == len(tables["documents"])
