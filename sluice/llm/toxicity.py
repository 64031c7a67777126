"""Toxicity by a convolutional text classifier.

Words are runs of letters and digits, in lower case. A word's embedding is the sum of those of its
pieces, the whole word and its first and last ``LENGTHS`` letters, so that inflected forms of a word
are alike. A hash table of ``SLOTS`` slots gives each piece that the training texts repeat an
embedding; a slot keeps the signature of its most frequent piece, so that pieces which only
happen to share a slot are unknown, and unknown ones weigh nothing. Filters of several widths slide
over the embeddings; each keeps its largest response in the text. A text is toxic by a logistic
function of these. Embeddings, filters and weights are trained together by gradient descent
with numpy.

One limit does not fit all languages, so after training a logit limit is chosen for each language
on rows that were kept out of it, and the score is moved so that 0.7 stands for that limit. The
language of a text is guessed from its own words, by word counts of the training rows: its ``lang``
is never read when it is scored.

The model is learned from every labelled row outside the held-out fold. Up to ``Training.per_class``
rows of each class and ``Training.most_chars`` characters are fitted in one task. Of more rows, such
a draw only gives the network that training starts from: pieces, shares of classes and languages
are counted over all rows, then tasks train on all rows side by side, each on its own part, and
their networks are averaged, an embedding over the tasks that changed it. Limits follow from
counts of all rows kept out, by steps of ``1 / _STEPS`` of a logit. It is applied to every whole
text without a shuffle; its size is bounded by ``Training.vocabulary`` pieces.

Null texts are taken as empty; those and texts without a word get the share of toxic rows as
their score, and every training step sees one such text as not toxic. If labels or documents repeat an id, the largest label and the least text count. Without
labels of both classes every score is 0. Null ids are never learned from. Repeated rows get equal
results, an empty table gives an empty one, and other columns are not read. Very long texts are
worked on in slices.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import release
from sluice.session import pin

SLOTS = 1 << 19
WIDTHS = (1, 2, 3)
LENGTHS = (3, 4, 5)
_PIECES = 1 + 2 * len(LENGTHS)
LIMIT = 0.7
_PAD = max(WIDTHS) - 1
_SLICE = 1 << 19
_POOLED = 1 << 16
_STEPS = 256
_LIMIT_LOGIT = float(np.log(LIMIT / (1 - LIMIT)))


@dataclass(frozen=True)
class Training:
    per_class: int = 3000
    most_chars: int = 24_000_000
    vocabulary: int = 120_000
    dimensions: int = 12
    filters: int = 6
    least_steps: int = 600
    passes: int = 6
    batch: int = 32
    rate: float = 0.05
    decay: float = 1e-4
    least_rows: int = 20  # of each class, for a limit of a language's own


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of fold 1 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


class Words:
    """64-bit hashes of the pieces of the words of texts."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        self.letter[[i for i in range(0x110000) if chr(i).isalnum()]] = True
        self.mixed = np.random.default_rng(11).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15
        self.powers = np.cumprod(np.full(2 * _SLICE, base, np.uint64))
        self.inverse = np.cumprod(np.full(2 * _SLICE, pow(base, -1, 1 << 64), np.uint64))

    def _slice(self, points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pieces of the words of some code points, 0 for none, and where the words begin."""
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        code = self.mixed[points & np.uint32(0xFFF)] * (points.astype(np.uint64) + np.uint64(1))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(code * self.powers[: len(points)], out=sums[1:])
        pieces = np.zeros((len(starts), _PIECES), np.uint64)
        spans = [(starts, ends)]
        spans += [span for n in LENGTHS for span in ((starts, starts + n), (ends - n, ends))]
        for kind, (low, high) in enumerate(spans):
            fits = np.flatnonzero((low >= starts) & (high <= ends))
            low, high = low[fits], high[fits]
            hashed = (sums[high] - sums[low]) * self.inverse[low]
            hashed ^= (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind)
            hashed ^= hashed >> np.uint64(32)
            pieces[fits, kind] = hashed * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        return pieces, starts

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``first text, pieces, texts of the words`` by slices; a long text's slices end between words."""
        group: list[np.ndarray] = []
        first, size = 0, 0
        for n, text in enumerate([*texts, ""]):
            points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            if group and (n == len(texts) or size + len(points) > _SLICE):
                yield self._group(first, group)
                group, size = [], 0
            if not group:
                first = n
            while len(points) > _SLICE:
                gaps = np.flatnonzero(~self.letter[points[_SLICE // 2 : _SLICE]])
                cut = _SLICE // 2 + int(gaps[-1]) if len(gaps) else _SLICE
                yield self._group(n, [points[:cut]])
                points = points[cut:]
            group.append(points)
            size += len(points)

    def _group(self, first: int, group: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        gap = np.array([32], np.uint32)
        points = np.concatenate([p for own in group for p in (own, gap)])
        begins = np.cumsum([0] + [len(p) + 1 for p in group[:-1]])
        pieces, starts = self._slice(points, self.letter[points])
        return first, pieces, first + np.searchsorted(begins, starts, "right") - 1


def slot_of(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(45)).astype(np.int64)


def signature_of(hashed: np.ndarray) -> np.ndarray:
    return (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Model:
    """Responses of each known piece to each filter and place, weights, and limits by language.

    Row 0 of the tables is for unknown pieces and all zero.
    """

    PARTS = ("slots", "signatures", "responses", "bias", "weights", "intercept", "languages", "counts", "priors", "limits")

    def __init__(self, **parts):
        for name in self.PARTS:
            setattr(self, name, np.asarray(parts[name]))
        self.rows = np.zeros(SLOTS, np.int32)
        self.rows[self.slots] = np.arange(1, len(self.slots) + 1)
        self.signed = np.concatenate([[np.uint32(0)], self.signatures]).astype(np.uint32)
        self.responses = self.responses.astype(np.float32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{name: getattr(self, name) for name in self.PARTS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Model":
        return cls(**np.load(io.BytesIO(data)))

    def known(self, pieces: np.ndarray) -> np.ndarray:
        rows = self.rows[slot_of(pieces)]
        return np.where((pieces != 0) & (self.signed[rows] == signature_of(pieces)), rows, 0)

    def logits(self, texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logits and guessed languages, as places in ``languages``; the last place is for no word."""
        pooled = np.full((len(texts), len(self.bias)), -np.inf, np.float32)
        speech = np.zeros((len(texts), len(self.languages)))
        seen = np.zeros(len(texts), np.int64)
        before = np.zeros((_PAD, self.responses.shape[1]), np.float32), np.full(_PAD, -1, np.int64)
        for _, pieces, whose in words(texts):
            if not len(pieces):
                continue
            _, first, inverse = np.unique(pieces[:, 0], return_index=True, return_inverse=True)
            rows = self.known(pieces[first])
            responses, counts = self.responses[rows[:, 0]], self.counts[rows[:, 0]]
            for kind in range(1, _PIECES):
                some = np.flatnonzero(rows[:, kind])
                responses[some] += self.responses[rows[some, kind]]
                counts[some] += self.counts[rows[some, kind]]
            seen += np.bincount(whose, minlength=len(texts))
            for k in range(len(self.languages)):
                speech[:, k] += np.bincount(whose, counts[inverse, k], len(texts))
            for low in range(0, len(inverse), _POOLED):
                # The last words of the part before come again, for windows across the cut.
                found = np.concatenate([before[0], responses[inverse[low : low + _POOLED]]])
                own = np.concatenate([before[1], whose[low : low + _POOLED]])
                self._pool(pooled, found, own)
                before = found[-_PAD:], own[-_PAD:]
        # A filter without a window gives nothing, like one whose largest response is negative.
        active = np.maximum(pooled + self.bias, 0)
        place = (speech + self.priors).argmax(1) if len(self.languages) else np.zeros(len(texts), np.int64)
        place = np.where(seen > 0, place, len(self.languages))
        return active @ self.weights + self.intercept, place

    def _pool(self, pooled: np.ndarray, words: np.ndarray, own: np.ndarray) -> None:
        """Largest responses of the windows of some words, of one text after the other."""
        filters = len(self.bias) // len(WIDTHS)
        at = 0
        for n, width in enumerate(WIDTHS):
            count = len(words) - width + 1
            found = words[:count, at * filters : (at + 1) * filters]
            for j in range(1, width):
                found = found + words[j : count + j, (at + j) * filters : (at + j + 1) * filters]
            at += width
            # A window lies in one text if both its ends do.
            inside = np.flatnonzero((own[:count] == own[width - 1 :]) & (own[:count] >= 0))
            text = own[inside]
            if len(text):
                begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                part = slice(n * filters, (n + 1) * filters)
                tops = np.maximum.reduceat(found[inside], begins)
                pooled[text[begins], part] = np.maximum(pooled[text[begins], part], tops)

    def scores(self, texts: list[str | None], words: Words) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        logits, place = self.logits(texts, words)
        return 1 / (1 + np.exp(-np.clip(logits - self.limits[place] + _LIMIT_LOGIT, -30, 30)))


def nothing() -> Model:
    parts = {name: np.zeros(0) for name in Model.PARTS}
    parts |= {"slots": np.zeros(0, np.int64), "languages": np.zeros(0, "U1"), "limits": np.zeros(1)}
    parts |= {"responses": np.zeros((1, 0)), "counts": np.zeros((1, 0))}
    return Model(**parts)


def vocabulary(pieces: list[np.ndarray], rules: Training) -> tuple[np.ndarray, np.ndarray]:
    """Slots and signatures of the pieces of two texts or more, the most frequent one of each slot."""
    found = [np.unique(p) for p in pieces]
    words, rows = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
    words, rows = words[(rows > 1) & (words != 0)], rows[(rows > 1) & (words != 0)]
    order = np.lexsort((words, -rows))[: rules.vocabulary]
    slots, first = np.unique(slot_of(words[order]), return_index=True)
    return slots, signature_of(words[order][first])


class Network:
    """The trained arrays, and one AdaGrad step after the other. Row 0 of ``table`` is for unknown pieces."""

    STATE = ("table", "maps", "bias", "weights", "intercept")

    def __init__(self, slots: np.ndarray, signatures: np.ndarray, rules: Training):
        self.slots, self.signatures, self.rules = slots, signatures, rules
        empty = {name: getattr(nothing(), name) for name in Model.PARTS}
        self.look = Model(**empty | {"slots": slots, "signatures": signatures})
        size, d, f = len(slots) + 1, rules.dimensions, rules.filters
        total, widths = f * len(WIDTHS), sum(WIDTHS)
        self.random = random = np.random.default_rng(1)
        self.table = random.normal(0, 0.1, (size, d))
        self.table[0] = 0
        self.maps = random.normal(0, 1 / np.sqrt(d), (widths, d, f))
        self.bias, self.weights, self.intercept = np.zeros(total), np.abs(random.normal(0, 0.3, total)), 0.0
        self.weights[::2] *= -1
        self.squares = {"table": np.full(self.table.shape, 1e-3), "maps": np.full(self.maps.shape, 1e-3)}
        self.squares |= {"bias": np.full(total, 1e-3), "weights": np.full(total, 1e-3), "intercept": 1e-3}

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {name: getattr(self, name) for name in ("slots", "signatures", *self.STATE)}
        np.savez_compressed(out, **arrays, **{f"squares_{name}": self.squares[name] for name in self.STATE})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, rules: Training) -> "Network":
        found = np.load(io.BytesIO(data))
        own = cls(found["slots"], found["signatures"], rules)
        for name in cls.STATE:
            setattr(own, name, found[name])
            own.squares[name] = found[f"squares_{name}"]
        return own

    def read(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Table rows of each different word, and the words of each text; word 0 is no word, without a known piece."""
        whole = np.concatenate([p[:, 0] for p in pieces])
        _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
        made = np.concatenate([np.zeros((1, _PIECES), np.int64), self.look.known(np.concatenate(pieces)[first])])
        return made, np.split(inverse + 1, np.cumsum([len(p) for p in pieces])[:-1])

    def _step(self, name, value, gradient, rows=None):  # rows: different ones
        """One AdaGrad step of an array, or of some of its rows."""
        squares, rate = self.squares, self.rules.rate
        if rows is None:
            squares[name] = squares[name] + gradient * gradient
            return value - rate * gradient / np.sqrt(squares[name])
        squares[name][rows] += gradient * gradient
        value[rows] -= rate * gradient / np.sqrt(squares[name][rows])
        return value

    def train(self, made: np.ndarray, ids: list[np.ndarray], labels: np.ndarray, balance: np.ndarray, learn: np.ndarray, passes: int) -> None:
        """Passes over the texts ``learn``."""
        rules, f = self.rules, self.rules.filters
        total = f * len(WIDTHS)
        for _ in range(passes):
            order = self.random.permutation(learn)
            for low in range(0, len(order), rules.batch):
                self._batch(made, ids, labels, balance, order[low : low + rules.batch], f, total)

    def _batch(self, made, ids, labels, balance, some, f: int, total: int) -> None:
        rules = self.rules
        # No words between the texts keep windows of two texts from mixing; the last text has none.
        parts = [np.concatenate([ids[i], np.zeros(_PAD, np.int64)]) for i in some]
        parts.append(np.zeros(_PAD, np.int64))
        truth, weight = np.append(labels[some], 0), np.append(balance[some], 1)
        begins = np.cumsum([0] + [len(p) for p in parts])
        flat = np.concatenate([*parts, np.zeros(_PAD, np.int64)])
        used, inverse = np.unique(flat, return_inverse=True)
        local = self.table[made[used]].sum(1)
        best = np.full((len(parts), total), -1, np.int64)
        pooled = np.zeros((len(parts), total))
        at = 0
        for n, width in enumerate(WIDTHS):
            response = np.zeros((len(flat) - _PAD, f))
            for j in range(width):
                response += (local @ self.maps[at + j])[inverse[j : len(flat) - _PAD + j]]
            part = slice(n * f, (n + 1) * f)
            for r in range(len(parts)):
                own = response[begins[r] : begins[r + 1] - _PAD - width + 1]
                if len(own):
                    top = own.argmax(0)
                    best[r, part] = begins[r] + top
                    pooled[r, part] = own[top, np.arange(f)] + self.bias[part]
            at += width
        active = np.where(best >= 0, np.maximum(pooled, 0), 0)
        logit = active @ self.weights + self.intercept
        slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth) * weight / len(truth)
        back = slope[:, None] * self.weights * (active > 0)
        grow = np.zeros_like(local)
        turn = np.zeros_like(self.maps)
        at = 0
        for n, width in enumerate(WIDTHS):
            rows, columns = np.nonzero(back[:, n * f : (n + 1) * f])
            push = back[rows, n * f + columns]
            for j in range(width):
                place = inverse[best[rows, n * f + columns] + j]
                np.add.at(grow, place, push[:, None] * self.maps[at + j][:, columns].T)
                np.add.at(turn[at + j].T, columns, push[:, None] * local[place])
            at += width
        hit = np.flatnonzero(grow.any(1))
        own = made[used[hit]]
        rows, back_to = np.unique(own, return_inverse=True)
        change = rules.decay * self.table[rows]
        np.add.at(change, back_to.reshape(own.shape), grow[hit][:, None])
        self.table = self._step("table", self.table, change[rows > 0], rows[rows > 0])
        self.maps = self._step("maps", self.maps, turn + rules.decay * self.maps)
        self.bias = self._step("bias", self.bias, back.sum(0))
        self.weights = self._step("weights", self.weights, slope @ active + rules.decay * self.weights)
        self.intercept = self._step("intercept", self.intercept, slope.sum())

    def model(self, speech, limits=None) -> Model:
        languages, counts, priors = speech
        responses = np.concatenate([self.table @ m for m in self.maps], axis=1).astype(np.float32)
        parts = dict(slots=self.slots, signatures=self.signatures, responses=responses, bias=self.bias, weights=self.weights)
        limits = np.zeros(len(languages) + 1) if limits is None else limits
        return Model(**parts, intercept=self.intercept, languages=languages, counts=counts, priors=priors, limits=limits)


def text_pieces(texts: list[str], words: Words) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros((0, _PIECES), np.uint64)] for _ in texts]
    for _, pieces, whose in words(texts):
        for n, low, high in zip(*np.unique(whose, return_index=True), np.append(np.flatnonzero(np.diff(whose)) + 1, len(whose))):
            parts[n].append(pieces[low:high])
    return [np.concatenate(p) for p in parts]


def balance_of(labels: np.ndarray, share: float, rows: int) -> np.ndarray:
    share = max(share, 1 / rows)
    return np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1 / rows))


def trained(texts: list[str], labels: np.ndarray, apart: np.ndarray, rules: Training, known=None):
    """The network on the rows outside ``apart``; these rows, and all texts as it reads them."""
    learn = np.flatnonzero(~apart) if len(set(labels[~apart].tolist())) == 2 else np.arange(len(texts))
    pieces = text_pieces(texts, Words())
    network = Network(*(known or vocabulary([pieces[i] for i in learn], rules)), rules)
    made, ids = network.read(pieces)
    passes = max(rules.passes, -(-rules.least_steps * rules.batch // len(learn)))
    network.train(made, ids, labels, balance_of(labels, labels[learn].mean(), len(learn)), learn, passes)
    return network, learn, made, ids


def fit(texts: list[str], labels: np.ndarray, langs: list[str | None], apart: np.ndarray, rules: Training) -> Model:
    """The network on the rows outside ``apart``, the limits on those inside."""
    if len(set(labels.tolist())) < 2:
        return nothing()
    network, learn, made, ids = trained(texts, labels, apart, rules)
    model = network.model(_speech([made[ids[i]].ravel() for i in learn], [langs[i] for i in learn], len(network.slots) + 1))
    # A small sample has too few rows apart for a limit.
    enough = len(labels[apart]) and 2 * np.bincount(labels[apart], minlength=2).min() >= rules.least_rows
    kept = np.flatnonzero(apart) if enough else np.arange(len(texts))
    logits, place = model.logits([texts[i] for i in kept], Words())
    model.limits = _limits(logits, place, labels[kept], len(model.languages), rules)
    model.limits[-1] = _wordless(network, labels.mean())
    return model


def _wordless(network: Network, share: float) -> float:
    """No word, no evidence: the limit at which the score is the share itself."""
    toxic = float(np.clip(share, 0.01, LIMIT / 2))
    return float(network.intercept) + _LIMIT_LOGIT - np.log(toxic / (1 - toxic))


def _speech(ids: list[np.ndarray], langs: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, log shares of each piece in them, and log shares of the languages."""
    languages = sorted({x for x in langs if x is not None})
    counts = np.zeros((size, len(languages)))
    rows = np.zeros(len(languages))
    for own, lang in zip(ids, langs):
        if lang is not None:
            k = languages.index(lang)
            counts[:, k] += np.bincount(own, minlength=size)
            rows[k] += 1
    return _shares(languages, counts, rows)


def _shares(languages: list[str], counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = counts + 0.1
    counts[0] = 1  # unknown pieces speak for no language
    shares = np.log(counts / counts[1:].sum(0)) if len(counts) > 1 else np.zeros_like(counts)
    shares[0] = 0
    return np.array(languages, dtype=str), shares, np.log(rows / max(rows.sum(), 1))


def _limit(logits: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> float:
    """The middle of the best cut: fewest mistakes, with both classes of equal weight."""
    order = np.argsort(logits, kind="stable")
    x, y, z = logits[order], (labels * rows)[order], ((1 - labels) * rows)[order]
    edges = np.flatnonzero(np.concatenate([[True], x[1:] > x[:-1], [True]]))
    below = np.concatenate([[0], np.cumsum(y)])[edges] / max(y.sum(), 1)
    above = 1 - np.concatenate([[0], np.cumsum(z)])[edges] / max(z.sum(), 1)
    wrong = below + above
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    gaps = [(x[min(e, len(x) - 1)] + x[max(e - 1, 0)]) / 2 for e in edges[best]]
    return float(np.median(gaps))


def _limits(logits, place, labels, languages: int, rules: Training, rows=None) -> np.ndarray:
    """By language, where both classes have enough rows; the limit over all rows for the others and the last place."""
    rows = np.ones(len(labels), np.int64) if rows is None else rows
    whole = _limit(logits, labels, rows)
    out = np.full(languages + 1, whole)
    for k in range(languages):
        own = place == k
        if min(rows[own & (labels == 1)].sum(), rows[own & (labels == 0)].sum()) >= rules.least_rows:
            out[k] = _limit(logits[own], labels[own], rows[own])
    return out


def learn(docs: DataFrame, labels: DataFrame, rules: Training = Training(), label: str = "toxic") -> bytes:
    """The model of all labelled rows outside the held-out fold."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 1))
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1))
    rows = own.join(marks, "doc_id").groupBy("doc_id").agg(
        F.min(F.struct("text", "lang")).alias("doc"), F.max("label").alias("label")
    )
    apart = F.crc32(F.concat(F.lit("apart"), F.col("doc_id").cast("string")))
    # Written: the tasks that learn must not be those that join and group.
    rows = pin(rows.select("doc_id", "doc.text", "doc.lang", "label", apart.alias("draw")), "labelled-rows")
    release(docs.sparkSession)
    sizes = rows.groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).collect()
    counts, chars = {r["label"]: r["rows"] for r in sizes}, sum(r["chars"] for r in sizes)
    if len(counts) < 2:
        return nothing().dump()
    if max(counts.values()) <= rules.per_class and chars <= rules.most_chars:
        return _in_one_task(rows, rules, lambda *found: fit(*found, rules).dump())
    return _in_many_tasks(rows, counts, chars, rules)


def _in_one_task(rows: DataFrame, rules: Training, work) -> bytes:
    """``work(texts, labels, langs, apart)`` on rows that are few enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in (4, 0, 1, 2, 3)))]
        # The order of rows must not depend on how they arrived.
        found.sort(key=lambda r: (r[0], str(r[1])))
        texts, langs, marks = [r[2] for r in found], [r[3] for r in found], np.array([r[4] for r in found], np.int64)
        done = work(texts, marks, langs, np.array([r[0] % 5 == 0 for r in found], bool)) if found else nothing().dump()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.binary())], ["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else nothing().dump()


def _in_many_tasks(rows: DataFrame, counts: dict[int, int], chars: int, rules: Training) -> bytes:
    """Every step over all rows, in as many tasks as Spark reads them with; only what is as small as the model is collected."""
    spark = rows.sparkSession
    apart = F.col("draw") % 5 == 0
    # Kept-out rows give limits only if both classes have enough of them.
    tally = {(r["apart"], r["label"]): r["n"] for r in rows.groupBy(apart.alias("apart"), "label").agg(F.count("*").alias("n")).collect()}
    some = all(tally.get((False, mark)) for mark in (0, 1))
    taught = rows.where(~apart) if some else rows
    enough = 2 * min(tally.get((True, mark), 0) for mark in (0, 1)) >= rules.least_rows
    kept = rows.where(apart) if enough else rows
    seen = {mark: tally.get((False, mark), 0) if some else counts[mark] for mark in (0, 1)}
    share, total = seen[1] / sum(seen.values()), sum(seen.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([f"={x}" if x is not None else "" for x in batch.column(1).to_pylist()], object)
            pieces = text_pieces(texts, words)
            for lang in sorted(set(langs.tolist())):
                own = [pieces[i].ravel() for i in np.flatnonzero(langs == lang)]
                found, times = np.unique(np.concatenate(own), return_counts=True)
                _, held = np.unique(np.concatenate([np.unique(p) for p in own]), return_counts=True)
                good = found != 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found[good].view(np.int64)),
                        pa.array([lang[1:] if lang else None] * int(good.sum()), pa.string()),
                        pa.array(held[good].astype(np.int64)),
                        pa.array(times[good].astype(np.int64)),
                    ],
                    ["piece", "lang", "held", "times"],
                )

    told = taught.select("text", "lang").mapInArrow(count, "piece long, lang string, held long, times long")
    told = pin(told.groupBy("piece", "lang").agg(F.sum("held").alias("held"), F.sum("times").alias("times")), "piece-counts")
    most = told.groupBy("piece").agg(F.sum("held").alias("held")).where("held > 1")
    most = pin(most.orderBy(F.col("held").desc(), "piece").limit(rules.vocabulary), "vocabulary")
    order = [r["piece"] for r in most.orderBy(F.col("held").desc(), "piece").collect()]
    hashed = np.array(order, np.int64).view(np.uint64)
    slots, first = np.unique(slot_of(hashed), return_index=True)
    known = slots, signature_of(hashed[first])
    place_of = {int(p): n + 1 for n, p in enumerate(hashed[first].view(np.int64))}

    langs = taught.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in langs]
    sums = np.zeros((len(slots) + 1, len(languages)))
    column = {x: k for k, x in enumerate(languages)}
    for r in told.where("lang IS NOT NULL").join(most.select("piece"), "piece").select("piece", "lang", "times").toLocalIterator():
        if r["piece"] in place_of:
            sums[place_of[r["piece"]], column[r["lang"]]] = r["times"]
    speech = _shares(languages, sums, np.array([r["n"] for r in langs], float))

    # The start: a draw of both classes that fits one task.
    room = min(1.0, rules.most_chars / max(chars, 1))
    part = F.when(F.col("label") == 1, min(room, rules.per_class / counts[1])).otherwise(min(room, rules.per_class / counts[0]))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000

    def begin(texts, marks, langs, out) -> bytes:
        return trained(texts, marks, out, rules, known)[0].dump()

    start = _in_one_task(rows.where(drawn < part), rules, begin)
    shared = spark.sparkContext.broadcast(start)
    d = rules.dimensions

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, words, before = None, Words(), None
        for batch in batches:
            if network is None:
                network = Network.load(shared.value, rules)
                before = network.table.copy()
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.int64)
            if not texts:
                continue
            made, ids = network.read(text_pieces(texts, words))
            network.train(made, ids, marks, balance_of(marks, share, total), np.arange(len(texts)), 1)
        if network is not None:
            moved = np.flatnonzero((network.table != before).any(1))
            flat = _flat(network, d)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([-1 - np.arange(len(flat)), moved])),
                    *(pa.array(np.concatenate([flat[:, i], network.table[moved, i]])) for i in range(d)),
                ],
                ["row", *(f"v{i}" for i in range(d))],
            )

    learned = taught.select("text", "label", "draw", "doc_id").sortWithinPartitions("draw", "doc_id").select("text", "label")
    learned = learned.mapInArrow(train, ", ".join(["row long", *(f"v{i} double" for i in range(d))]))
    network = Network.load(start, rules)
    flat = _flat(network, d)
    for r in learned.groupBy("row").agg(*(F.avg(f"v{i}") for i in range(d))).toLocalIterator():
        (network.table if r[0] >= 0 else flat)[r[0] if r[0] >= 0 else -1 - r[0]] = r[1:]
    _unflat(network, flat)

    model = network.model(speech)
    judge = spark.sparkContext.broadcast(model.dump())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = Model.load(judge.value), Words()
        for batch in batches:
            logits, place = own.logits(batch.column(0).to_pylist(), words)
            steps = np.floor(np.clip(logits, -1e6, 1e6) * _STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(place.astype(np.int64)), batch.column(1)], ["step", "place", "label"])

    found = kept.select("text", "label").mapInArrow(judged, "step long, place long, label int")
    found = found.groupBy("step", "place", "label").agg(F.count("*").alias("n")).orderBy("step", "place", "label").collect()
    step, place, mark, n = (np.array(c, np.int64) for c in zip(*found))
    model.limits = _limits((step + 0.5) / _STEPS, place, mark, len(languages), rules, n)
    model.limits[-1] = _wordless(network, counts[1] / sum(counts.values()))
    return model.dump()


def _flat(network: Network, width: int) -> np.ndarray:
    """All arrays but the table, in rows of ``width``."""
    flat = np.concatenate([np.ravel(getattr(network, name)) for name in Network.STATE[1:]])
    return np.pad(flat, (0, -len(flat) % width)).reshape(-1, width)


def _unflat(network: Network, flat: np.ndarray) -> None:
    values, at = flat.ravel(), 0
    for name in Network.STATE[1:]:
        shape = np.shape(getattr(network, name))
        size = int(np.prod(shape))
        setattr(network, name, values[at : at + size].reshape(shape))
        at += size


def score(docs: DataFrame, model: bytes, limit: float = LIMIT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = Model.load(shared.value), Words()
        for batch in batches:
            scores = own.scores(batch.column(2).to_pylist(), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= limit).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity_report(docs: DataFrame, labels: DataFrame, rules: Training = Training()) -> DataFrame:
    return score(docs, learn(docs, labels, rules))
