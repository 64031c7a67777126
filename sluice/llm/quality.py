"""Quality rules: simple counts, and how far a text's histograms lie from its language's.

Two histograms per text: classes of characters, and common words of several languages.
Their Jensen-Shannon distance to each language's reference is taken, and the nearest
reference counts, so that a text may name the wrong one of these languages, or none. A text that
names a language without a reference has no verdict but that of the base rule. References are sums over all texts that pass the simple rules and name a known language; there are as
many as ``COMMON_WORDS`` has languages, so they fit into the plan as literals. Short texts
have ragged histograms, hence the minimum lengths below which a distance is not judged.

All of it is built-in functions on each row; the one shuffle sums the references.

Null and empty texts have no words, so they fail the base rule. Rows are independent:
repeated rows get equal results. Without any reference the distances are null and only the
base rules decide. An empty table gives an empty result. Very long texts are read whole;
work per text is that of sorting its word windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACE_RUN, free_name, let, split_words

#: Ten frequent words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that for on with",
    "de": "der die und in den von zu das mit ist",
    "fr": "de la le et les des en un une que",
    "es": "de la que el en los del las por un",
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})

#: Character classes, taken off the text one after the other; the rest is a class too.
CLASSES = {
    "lower": "[a-z]+",
    "space": SPACE_RUN,
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "symbol": "[#*$%&|<>]+",
    "mark": r"[.,;:!?'\"()\-]+",
    "other_lower": r"\p{Ll}+",
    "other_letter": r"\p{L}+",
}


@dataclass(frozen=True)
class QualityRules:
    """Limits; a distance is judged from the stated number of words or characters on."""

    min_words: int = 50
    max_repeat_percent: int = 50
    class_distance: float = 0.25
    class_min_chars: int = 200
    word_distance: float = 0.23
    word_min_words: int = 150


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first included."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def doubles(s: Column) -> Column:
            return F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)),
                    ),
                    lambda e: e["i"],
                )
            )

        def width(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        return let(placed, lambda s: let(doubles(s), width))

    def windows(w: Column) -> Column:
        starts = F.slice(w, 1, F.size(w) - 2)
        return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def count(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(
            let(
                windows(w),
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
            )
        )

    return let(words, count)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def word_counts(words: Column) -> Column:
    """How often each of ``WORDS`` stands in ``words``."""
    hits = F.filter(words, lambda w: w.isin(WORDS))
    joined = F.concat(F.lit("|"), F.array_join(hits, "||"), F.lit("|"))

    def counts(line: Column) -> Column:
        full = F.octet_length(line)
        return F.array(
            *(
                ((full - F.octet_length(F.replace(line, F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)).cast("int")
                for w in WORDS
            )
        )

    return let(joined, counts)


class Measured:
    """``docs`` with its counts, under names that the table does not have."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        self.source = docs
        self.names: dict[str, str] = {}
        self.frame = docs
        self.add("text", F.coalesce(F.col(text).cast("string"), F.lit("")))
        self.add("words", split_words(self["text"]))
        self.add("n_words", F.size(self["words"]))
        self.add("n_chars", F.length(self["text"]))
        rest, left, sizes = self["text"], self["n_chars"], []
        for name, pattern in CLASSES.items():
            self.add(f"without_{name}", F.regexp_replace(rest, pattern, ""))
            rest = self[f"without_{name}"]
            self.add(f"left_{name}", F.length(rest))
            sizes.append(left - self[f"left_{name}"])
            left = self[f"left_{name}"]
        self.add("classes", F.array(*sizes, left))
        self.add("common", word_counts(self["words"]))
        self.add("word_bins", F.concat(self["common"], F.array(self["n_words"] - self._sum(self["common"]))))
        self.add("n_repeat_words", repeated_words(self["words"]))
        self.add("n_dup_lines", duplicate_lines(self["text"]))

    def add(self, name: str, value: Column) -> None:
        self.names[name] = free_name(self.frame, f"measured_{name}")
        self.frame = self.frame.withColumn(self.names[name], value)

    def __getitem__(self, name: str) -> Column:
        return F.col(self.names[name])

    def count_of(self, name: str) -> Column:
        return F.get(self["classes"], F.lit(list(CLASSES).index(name)))

    @staticmethod
    def _sum(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)


BINS = {"classes": len(CLASSES) + 1, "word_bins": len(WORDS) + 1}


def base_failed(m: Measured, rules: QualityRules) -> Column:
    return (m["n_words"] < rules.min_words) | (
        F.lit(100) * m["n_repeat_words"].cast("long") > rules.max_repeat_percent * m["n_words"].cast("long")
    )


def references(docs: DataFrame, rules: QualityRules, text: str = "text", lang: str = "lang") -> dict:
    """Histogram sums of each known language over the whole table; at most a row per language."""
    few = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isin(list(COMMON_WORDS)))
    measured = Measured(few, "text")
    sums = [
        F.sum(F.get(measured[kind], F.lit(i)).cast("long")).alias(f"{kind}_{i}")
        for kind, size in BINS.items()
        for i in range(size)
    ]
    rows = measured.frame.where(~base_failed(measured, rules)).groupBy("lang").agg(*sums).collect()
    found = {
        kind: [[row[f"{kind}_{i}"] for i in range(size)] for row in sorted(rows, key=lambda r: r["lang"])]
        for kind, size in BINS.items()
    }
    return found | {"languages": sorted(row["lang"] for row in rows)}


def nearest_distance(bins: Column, known: list[list[int]]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) to the nearest reference; null without one."""

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def distance(counts: Column, reference: list[int]) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda x, y: x + y)
        shares = F.array(*(F.lit(v / sum(reference)) for v in reference))

        def spread(n: Column) -> Column:
            parts = F.zip_with(
                counts,
                shares,
                lambda c, q: let(c / n, lambda p: (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2),
            )
            return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)))

        return F.when(total > 0, let(total, spread))

    usable = [r for r in known if sum(r)]
    if not usable:
        return F.lit(None).cast("double")
    return let(bins, lambda b: F.array_min(F.array(*(distance(b, r) for r in usable))))


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> Measured:
    """``docs`` with counts, distances, ``base_failed`` and ``kept``."""
    known = references(docs, rules, text, lang)
    m = Measured(docs, text)
    m.add("base_failed", base_failed(m, rules))
    m.add("class_distance", nearest_distance(m["classes"], known["classes"]))
    m.add("word_distance", nearest_distance(m["word_bins"], known["word_bins"]))
    odd_classes = (m["n_chars"] >= rules.class_min_chars) & (m["class_distance"] > rules.class_distance)
    odd_words = (m["n_words"] >= rules.word_min_words) & (m["word_distance"] > rules.word_distance)
    odd = F.coalesce(odd_classes, F.lit(False)) | F.coalesce(odd_words, F.lit(False))
    # No reference, no verdict: the nearest of other languages says nothing.
    comparable = F.col(lang).isNull() | F.col(lang).isin(known["languages"])
    m.add("kept", ~m["base_failed"] & ~(comparable & odd))
    return m


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: its counts, distances and the verdict."""
    m = judge(docs.select("doc_id", "text", "lang"), rules)
    return m.frame.select(
        "doc_id",
        m["n_words"].cast("long").alias("n_words"),
        (m["n_chars"] - m.count_of("space")).cast("long").alias("word_chars"),
        m.count_of("symbol").cast("long").alias("n_symbols"),
        m["n_dup_lines"].cast("long").alias("n_dup_lines"),
        m["n_repeat_words"].cast("long").alias("n_repeat_words"),
        m["base_failed"].alias("base_failed"),
        m["class_distance"].alias("class_distance"),
        m["word_distance"].alias("word_distance"),
        m["kept"].alias("kept"),
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns."""
    m = judge(docs, rules)
    # As a filter the verdict would be moved below the counts, which then are computed several times.
    once = free_name(docs, "measured_once")
    rows = m.frame.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.when(m["kept"], F.array(F.lit(True)))).alias(once))
    return rows.drop(once)
