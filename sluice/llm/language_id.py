"""Language identification by sparse multinomial logistic regression.

Features are character 1- to 3-grams of the lower-case letters of a text, runs of anything
else being one space, hashed to ``DIMENSIONS``; values are shares of the text times inverse
document frequencies. Weights are learned with the follow-the-regularised-leader method for
coordinates with L1 and L2 penalties, so most are zero. A temperature, fitted on texts kept
out of that, calibrates the probabilities.

The model is fitted in one task on a bounded sample of labelled rows, drawn by a hash of the
row: about ``Training.per_language`` rows of each language, or with many languages an equal share
of ``Training.most_rows``, so that each of them is learned; beyond a thousand languages it is
``Training.least_rows`` of each. It learns from the text and ``lang`` of rows outside the held-out fold only. It is
applied to every whole text without a shuffle; its size is bounded by ``DIMENSIONS`` times
the languages.

Null texts and texts without a letter are ``und`` with score 0. Null languages are not
learned from; if no row is labelled, all texts are ``und``. Rows are independent, so repeated
rows get equal results; an empty table gives an empty result; other columns are not read.
Very long texts are worked on in slices.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_SLICE = 1 << 19


@dataclass(frozen=True)
class Training:
    per_language: int = 1000
    most_rows: int = 20_000
    least_rows: int = 20
    passes: int = 3
    least_steps: int = 400
    batch: int = 32
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 10.0

    def rows_of_each(self, languages: int) -> int:
        """Rows drawn of a language: all have their share of ``most_rows``, at least ``least_rows``."""
        return max(self.least_rows, min(self.per_language, self.most_rows // max(1, languages)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


class Grams:
    """Hashed character grams of texts."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        self.letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed grams one text after the other, their texts, and which texts have a letter."""
        parts, owners = [], []
        lettered = np.zeros(len(texts), bool)
        for n, text in enumerate(texts):
            points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            is_letter = self.letter[points]
            lettered[n] = is_letter.any()
            points = np.where(is_letter, points, np.uint32(32))
            points = np.concatenate([[32], points, [32]]).astype(np.uint64)
            keep = np.ones(len(points), bool)
            keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
            parts.append(points[keep])
            owners.append(np.full(len(parts[-1]), n, np.int64))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), lettered
        points, owner = np.concatenate(parts), np.concatenate(owners)
        found, whose = [], []
        for order in ORDERS:
            if len(points) < order:
                continue
            code = np.full(len(points) - order + 1, order, np.uint64)
            for j in range(order):
                code = code * np.uint64(0x1FFFFF) + points[j : len(points) - order + 1 + j]
            own = owner[: len(code)] == owner[order - 1 :]
            if order == 1:
                own &= points != 32
            hashed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)
            found.append(hashed[own].astype(np.int64))
            whose.append(owner[: len(code)][own])
        return np.concatenate(found), np.concatenate(whose), lettered


class Model:
    """Weights with the document frequencies in them, the languages and the temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature

    def dump(self) -> bytes:
        """Only the rows with a weight."""
        used = np.flatnonzero(self.weights.any(1))
        out = io.BytesIO()
        np.savez_compressed(
            out, used=used, weights=self.weights[used], bias=self.bias, temperature=self.temperature, languages=np.array(self.languages)
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Model":
        parts = np.load(io.BytesIO(data))
        weights = np.zeros((DIMENSIONS, len(parts["bias"])), np.float32)
        weights[parts["used"]] = parts["weights"]
        return cls([str(x) for x in parts["languages"]], weights, parts["bias"], float(parts["temperature"]))

    def logits(self, texts: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Scores before calibration, and which texts have a letter; long texts in slices."""
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        lettered = np.zeros(len(texts), bool)
        group: list[tuple[int, str]] = []
        size = 0

        def flush():
            found, whose, has = grams([t for _, t in group])
            rows = np.array([n for n, _ in group])
            np.logical_or.at(lettered, rows, has)
            counts_here = np.bincount(whose, minlength=len(group))
            np.add.at(counts, rows, counts_here)
            for k in range(len(self.languages)):
                own = np.bincount(whose, weights=self.weights[found, k], minlength=len(group))
                np.add.at(sums[:, k], rows, own)

        for n, text in enumerate(texts):
            for low in range(0, max(1, len(text)), _SLICE):
                part = text[low : low + _SLICE]
                if group and size + len(part) > _SLICE:
                    flush()
                    group, size = [], 0
                group.append((n, part))
                size += len(part)
        if group:
            flush()
        return sums / np.maximum(counts, 1)[:, None] + self.bias, lettered

    def predict(self, texts: list[str | None], grams: Grams) -> tuple[list[str], np.ndarray]:
        logits, lettered = self.logits([t or "" for t in texts], grams)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        shares = softmax(logits / self.temperature)
        best = shares.argmax(1)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())]
        return names, np.where(lettered, shares.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], calibrate: np.ndarray, rules: Training) -> Model:
    """FTRL on the rows outside ``calibrate``, then a temperature on those inside."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), 1.0)
    grams = Grams()
    target = np.searchsorted(languages, labels)
    rows = []
    seen = np.zeros(DIMENSIONS)
    for text in texts:
        found, _, _ = grams([text])
        at, count = np.unique(found, return_counts=True)
        rows.append((at, count / max(1, len(found))))
        seen[at] += 1
    idf = np.log((1 + len(texts)) / (1 + seen)) + 1
    d, k = DIMENSIONS + 1, len(languages)
    z, n, w = np.zeros((d, k)), np.zeros((d, k)), np.zeros((d, k))
    learn = np.flatnonzero(~calibrate)
    random = np.random.default_rng(1)
    # A small sample is gone through more often.
    passes = max(rules.passes, -(-rules.least_steps * rules.batch // max(1, len(learn)))) if len(learn) else 0
    for _ in range(passes):
        order = random.permutation(learn)
        for low in range(0, len(order), rules.batch):
            some = order[low : low + rules.batch]
            # The features of the batch only, as a small dense matrix.
            used = np.unique(np.concatenate([*(rows[i][0] for i in some), [DIMENSIONS]]).astype(np.int64))
            x = np.zeros((len(some), len(used)))
            for r, i in enumerate(some):
                x[r, np.searchsorted(used, rows[i][0])] = rows[i][1] * idf[rows[i][0]] * rules.scale
            x[:, -1] = 1.0
            shares = softmax(x @ w[used])
            shares[np.arange(len(some)), target[some]] -= 1
            g = x.T @ shares / len(some)
            own_n = n[used]
            z[used] += g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / rules.alpha * w[used]
            n[used] = own_n + g * g
            own_z = z[used]
            step = (rules.beta + np.sqrt(n[used])) / rules.alpha + rules.l2
            # The penalties hold for the mean over the rows of a pass.
            shrunk = np.abs(own_z) - rules.l1
            w[used] = np.where(shrunk <= 0, 0, -np.sign(own_z) * shrunk / step)
    weights = (w[:-1] * idf[:, None] * rules.scale).astype(np.float32)
    model = Model(languages, weights, w[-1], 1.0)
    kept = np.flatnonzero(calibrate)
    if len(kept):
        logits, _ = model.logits([texts[i] for i in kept], grams)
        choices = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
        losses = [-np.log(softmax(logits / t)[np.arange(len(kept)), target[kept]] + 1e-300).mean() for t in choices]
        model.temperature = float(choices[int(np.argmin(losses))])
    return model


def learn(docs: DataFrame, rules: Training = Training()) -> bytes:
    """The model of the rows outside the held-out fold, fitted in one task on the sample."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [], np.zeros(0, bool), rules).dump()
    wanted = rules.rows_of_each(len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, wanted / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    sample = own.where(draw < share)
    sample = sample.select("text", "lang", (fold(F.col("doc_id")) == 1).alias("calibrate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, kept = [], [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            kept += batch.column(2).to_pylist()
        # The order of rows must not depend on how they arrived.
        rows = sorted(zip(texts, labels, kept))
        texts, labels, kept = ([r[i] for r in rows] for i in range(3))
        model = fit(texts, labels, np.array(kept, bool), rules)
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else fit([], [], np.zeros(0, bool), rules).dump()


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grams = Model.load(shared.value), Grams()
        for batch in batches:
            names, scores = own.predict(batch.column(2).to_pylist(), grams)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame, rules: Training = Training()) -> DataFrame:
    return identify(docs, learn(docs, rules))
