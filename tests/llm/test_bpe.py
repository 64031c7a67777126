import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import bpe
from llm.conftest import ODD, sentence


@pytest.fixture(scope="module")
def own():
    import public_tokenizers

    return bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def library(own, texts):
    return [e.ids for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def parts(own, texts, chunked=True):
    data, starts = bpe.text_buffer(pa.array(texts, pa.string()))
    ids, bounds = own.encode(data, starts, chunked)
    assert [t.decode() for t in own.decode(ids, bounds)] == [t or "" for t in texts]
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


TRICKY = ["  a", "a  ", "x  <|endoftext|> y", "<|endoftext|>", " <|endoftext|>  <|endoftext|>", "a  b 　 c", "it's we'll 'S  's"]
ATOMS = ["a", " ", "\n", "é", "'s", " the", "1", "<|endoftext|>", "!", "  ", "日本", "\x1c", " ", "😀"]


@pytest.mark.parametrize("chunked", [True, False])
def test_ids_are_the_librarys(own, chunked):
    draw = random.Random(1)
    texts = ODD + TRICKY + ["".join(draw.choice(ATOMS) for _ in range(draw.randrange(2000))) for _ in range(60)]
    texts += [sentence(n, 3000) for n in range(5)]
    assert parts(own, texts, chunked) == library(own, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\té'1! ")), max_size=6))
def test_any_white_space(own, texts):
    assert parts(own, texts) == library(own, texts)


def test_slices_and_small_memory(own, monkeypatch):
    """Work in small slices with a memory that keeps starting again gives the same ids."""
    import public_tokenizers

    monkeypatch.setattr(bpe, "SLICE_BYTES", 300)
    small = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"), memo_entries=40)
    texts = [sentence(n % 4, 900) for n in range(8)] + ["y" * 2000, ""]
    assert parts(small, texts) == library(own, texts)


def test_shared_passages_are_encoded_once(own):
    import public_tokenizers

    fresh = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    shared = sentence(99, 4000, 10**6)
    parts(fresh, [sentence(1, 30) + " " + shared])
    known = len(fresh.chunks.keys)
    calls = []
    call = fresh._call
    fresh._call = lambda texts: calls.extend(texts) or call(texts)
    texts = [sentence(2, 41) + " " + shared + " " + sentence(3, 50)]
    assert parts(fresh, texts) == library(own, texts)
    assert len(fresh.chunks.keys) - known < 20
    assert sum(map(len, calls)) < len(shared) / 4


def test_round_trip(spark, make_docs, tokenizer, own):
    texts = ODD + TRICKY
    docs = make_docs(texts).selectExpr("*", "'mine' AS ids_sha256", "n_chars AS `a.b`")
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, tokenizer, ids=True).collect()}
    assert "a.b" in rows[0].asDict()
    for n, (text, ids) in enumerate(zip(texts, library(own, texts))):
        assert list(rows[n]["ids"]) == ids and rows[n]["n_tokens"] == len(ids)
        assert rows[n]["decoded"] == (text or "")
        assert rows[n]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[n]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), tokenizer).count() == 0


def thue_morse(size, letters="ab"):
    """Text and mirror whose sums modulo 2^64 are equal for any odd base."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
@pytest.mark.parametrize("chunked", [True, False])
def test_texts_with_equal_hashes(tokenizer, size, chunked):
    own = bpe.Encoder(tokenizer)
    one, two = thue_morse(size)
    data = np.frombuffer((one + two).encode(), np.uint8)
    ends = np.array([size, 2 * size])
    assert len(set(own.hash(data, ends - size, ends).tolist())) == 1
    texts = [one, two, f"Say {one} and", f"Say {two} and", two, one, f"{two} {one}\n{two}", f"{one} {two}\n{one}"]
    for _ in range(2):  # new, then remembered
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        ids, bounds = own.encode(data, starts, chunked)
        for n, text in enumerate(texts):
            assert ids[bounds[n] : bounds[n + 1]].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
