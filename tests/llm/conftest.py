import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from texts; ids count up unless given."""

    def make(texts, ids=None, extra=""):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sentence(seed, size, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(size))


#: Texts that every operator must take.
ODD = [None, "", " ", "\n\n", "a", "a b", "\t x \r\n y\x0bz", "İstanbul ß É é 日本 語", "x " * 3000, "word" * 5000]
