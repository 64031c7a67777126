import zlib

import numpy as np
import pytest
import zstandard

from sluice import storage
from sluice.llm import bpe, token_store
from sluice.session import new_scratch
from llm.conftest import ODD, sentence


def expected(texts, ids, tokenizer):
    own = bpe.Encoder(tokenizer)
    order = sorted(range(len(texts)), key=lambda n: (ids[n] is not None, ids[n] or 0))
    start, out = 0, []
    for n in order:
        tokens = own.tokenizer.encode(texts[n] or "", add_special_tokens=False).ids + [0]
        out.append((ids[n], start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    return out


def test_places_and_checksums(spark, make_docs, tokenizer):
    texts = ODD + [sentence(n, 700) for n in range(30)]
    ids = [None, *(len(texts) * 3 - 3 * n for n in range(1, len(texts)))]
    rows = token_store.store_tokens(spark, make_docs(texts, ids), tokenizer, frame_ids=500).collect()
    got = sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == expected(texts, ids, tokenizer)


def test_repeated_rows_and_no_rows(spark, make_docs, tokenizer):
    docs = make_docs(["a b c"] * 6 + ["d"], [5] * 6 + [1])
    rows = sorted(map(tuple, token_store.store_tokens(spark, docs, tokenizer).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [1, 5, 5, 5, 5, 5, 5]
    assert [r[1] for r in rows] == list(np.cumsum([0, *(r[2] for r in rows[:-1])]))
    assert token_store.store_tokens(spark, docs.limit(0), tokenizer).count() == 0


def test_any_zstandard_reader_unpacks_a_shard(spark, make_docs, tokenizer):
    folder = storage.qualify(spark, new_scratch(spark, "tokens"))
    manifest = token_store.write_shards(make_docs([sentence(n, 300) for n in range(4)]), tokenizer, folder)
    for row in manifest.collect():
        data = open(row["path"].removeprefix("file:"), "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(plain) == 2 * row["n_tokens"]


def test_only_the_wanted_frames_are_read(spark, make_docs, tokenizer):
    folder = storage.qualify(spark, new_scratch(spark, "tokens"))
    docs = make_docs([sentence(n, 400) for n in range(40)]).coalesce(1)
    manifest = token_store.write_shards(docs, tokenizer, folder, frame_ids=1000)
    path = max(manifest.collect(), key=lambda r: r["n_tokens"])["path"].removeprefix("file:")
    data = open(path, "rb").read()
    asked = []
    reader = token_store.ShardReader(lambda n, at: asked.append(n) or data[at : at + n], len(data))
    asked.clear()
    ids = np.concatenate(list(reader.ids(len(reader.docs) - 1)))
    assert len(ids) == reader.lengths[-1] and sum(asked) < len(data) / 3
    broken = bytearray(data)
    broken[20] ^= 255
    reader = token_store.ShardReader(lambda n, at: bytes(broken[at : at + n]), len(data))
    with pytest.raises(Exception):
        list(reader.ids(0))
    wanted = spark.createDataFrame([(3,), (17,), (999,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in token_store.read_documents(manifest, wanted).collect()}
    own = bpe.Encoder(tokenizer)
    assert set(got) == {3, 17}
    assert list(got[17]) == own.tokenizer.encode(sentence(17, 400), add_special_tokens=False).ids + [0]


def test_texts_with_equal_hashes(spark, make_docs, tokenizer):
    from llm.test_bpe import thue_morse

    texts = [*thue_morse(1024), *thue_morse(4096), *(f"x {t} y" for t in thue_morse(1024))]
    docs = make_docs(texts).coalesce(1)
    got = sorted(map(tuple, token_store.store_tokens(spark, docs, tokenizer).collect()))
    assert got == expected(texts, list(range(len(texts))), tokenizer)
