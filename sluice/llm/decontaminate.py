"""Benchmark decontamination by winnowing.

Every 10-word window of a benchmark item (the whole item if it is shorter) has one
fingerprint: the least hash of the k-word runs in it. Winnowing a document by the same
rule keeps, of all windows, the distinct fingerprints only, so a span shared with an item
has a fingerprint in common with it wherever it stands: nothing of that length is missed.
Documents that share a fingerprint are read again, and the windows behind it are compared
word by word; runs of equal windows make up the hits at their full extent.

Items of fewer words than a window have a window of their own length; there are at most
nine such lengths, each with its own fingerprints. Equal windows of several items count as
one until the items are listed.

Hot spots: a passage in a third of all documents gives that many rows in joins against
unique fingerprints or windows, which split; nothing is collected but a document's own hits.
The benchmark side is a written table of known size, which Catalyst broadcasts only below
its threshold.

Null and empty texts have no words, no hits, and are not contaminated; such items have no
windows. A document is known by its id and text, so rows with the same id and other text
are judged apart, and repeated rows have equal results. Null document ids are kept. Null
item ids give hits but are not listed; items are told apart by id. Either table may be
empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ascii_lower, free_name, let
from sluice.session import pin

WINDOW = 10

#: What separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    parts = F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS)
    # Only the first and the last part can be empty.
    return let(
        parts,
        lambda p: let(
            F.slice(p, F.when(F.get(p, F.lit(0)) == "", 2).otherwise(1), F.size(p)),
            lambda q: F.when(F.get(q, F.size(q) - 1) == "", F.slice(q, 1, F.size(q) - 1)).otherwise(q),
        ),
    )


def fingerprints(words: Column, length: int) -> Column:
    """The fingerprint of each window of ``length`` words, in order."""
    run = (length + 1) // 2
    span = length - run + 1

    def runs(hashed: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(hashed) - run + 1),
            lambda i: F.xxhash64(F.lit(length), F.slice(hashed, i, run)),
        )

    def least(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(hashes) - span + 1), lambda i: F.array_min(F.slice(hashes, i, span))
        )

    def of(hashed: Column) -> Column:
        return F.when(F.size(hashed) < length, F.array().cast("array<bigint>")).otherwise(
            runs(hashed) if span == 1 else let(runs(hashed), least)
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


class Benchmark:
    """Windows of the items, written once: unique windows, and which items have them."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW):
        self.window = window
        items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
        sized = items.where(F.size("words") > 0).withColumn("width", F.least(F.lit(window), F.size("words")))
        spans = F.transform(
            F.sequence(F.lit(1), F.size("words") - F.col("width") + 1),
            lambda i: F.array_join(F.slice(F.col("words"), i, F.col("width")), " "),
        )
        pairs = pin(sized.select("item_id", "width", F.explode(spans).alias("gram")).distinct(), "benchmark-pairs")
        self.widths = [r["width"] for r in pairs.select("width").distinct().collect()]  # at most `window`
        cut = F.split("gram", " ")
        own = F.lit(None).cast("bigint")
        for width in self.widths:
            own = F.when(F.col("width") == width, F.get(fingerprints(cut, width), F.lit(0))).otherwise(own)
        grams = pairs.select("width", "gram").distinct().select("gram", "width", own.alias("print"))
        # Written with its numbers, so they stay the same whoever reads them.
        self.grams = pin(grams.withColumn("gram_id", F.monotonically_increasing_id()), "benchmark-grams")
        self.prints = pin(self.grams.select("print").distinct(), "benchmark-prints")
        self.items = pin(
            pairs.where(F.col("item_id").isNotNull()).join(self.grams.select("gram", "gram_id"), "gram").select("item_id", "gram_id"),
            "benchmark-items",
        )


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


class Hits:
    """Word windows of documents that stand in items; each table is written once.

    ``known``: a row per document row with ``n_words``. ``hits``: the distinct windows of
    each document, as first word, width and number of the benchmark window.
    """

    def __init__(self, docs: DataFrame, benchmark: Benchmark):
        few = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
        worded = few.withColumn("words", words_of(F.col("text")))
        prints = [fingerprints(F.col("words"), width) for width in benchmark.widths]
        every = F.array_distinct(F.concat(*prints)) if prints else F.array().cast("array<bigint>")
        self.known = pin(
            worded.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), every.alias("prints")),
            "winnowed",
        )
        met = (
            self.known.select("doc_id", "text_hash", F.explode("prints").alias("print"))
            .join(benchmark.prints, "print", "left_semi")
            .groupBy("doc_id", "text_hash")
            .agg(F.collect_set("print").alias("met"))
        )
        met = pin(met, "winnowed-met")
        again = few.join(met, _same(few, met)).select(met["doc_id"], met["text_hash"], "text", "met")
        again = again.withColumn("words", words_of(F.col("text")))
        spans = F.concat(*(self._met(width) for width in benchmark.widths)) if benchmark.widths else None
        if spans is None:
            self.hits = met.select("doc_id", "text_hash", F.lit(0).alias("first"), F.lit(0).alias("width"), F.lit(0).cast("long").alias("gram_id")).limit(0)
            return
        found = again.select("doc_id", "text_hash", F.explode(spans).alias("span"))
        found = found.select("doc_id", "text_hash", F.col("span.first").alias("first"), F.col("span.gram").alias("gram"))
        hits = found.join(benchmark.grams.select("gram", "width", "gram_id"), "gram")
        self.hits = pin(hits.select("doc_id", "text_hash", "first", "width", "gram_id"), "winnowed-hits")

    @staticmethod
    def _met(width: int) -> Column:
        """Windows of one width whose fingerprint was met, with their words."""

        def of(words: Column) -> Column:
            chosen = F.filter(
                F.transform(fingerprints(words, width), lambda p, i: F.struct(p.alias("print"), i.alias("first"))),
                lambda s: F.array_contains(F.col("met"), s["print"]),
            )
            return F.transform(
                chosen,
                lambda s: F.struct(
                    s["first"].alias("first"), F.array_join(F.slice(words, s["first"] + 1, width), " ").alias("gram")
                ),
            )

        return let(F.col("words"), of)


def covered(spans: Column) -> Column:
    """Words inside any of the sorted ``(first, width)`` spans."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    done = F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            (a["total"] + F.greatest(F.lit(0), s["first"] + s["width"] - F.greatest(a["end"], s["first"]))).alias("total"),
            F.greatest(a["end"], s["first"] + s["width"]).alias("end"),
        ),
    )
    return done["total"]


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words in shared windows, and the items they come from."""
    bench = Benchmark(benchmark, window)
    found = Hits(docs, bench)
    key = ["doc_id", "text_hash"]
    spans = found.hits.groupBy(*key).agg(
        covered(F.sort_array(F.collect_set(F.struct("first", "width")))).alias("n_hit")
    )
    items = (
        found.hits.select(*key, "gram_id").distinct().join(bench.items, "gram_id")
        .groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    both = spans.join(items, _same(spans, items), "left").select(spans["doc_id"], spans["text_hash"], "n_hit", "items")
    both = pin(both, "contaminated")
    known = found.known.select(*key, "n_words")
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return known.join(both, _same(known, both), "left").select(
        known["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a shared window, with its own columns."""
    found = Hits(docs, Benchmark(benchmark, window))
    bad = pin(found.hits.select("doc_id", "text_hash").distinct(), "contaminated-keys")
    name = free_name(docs, "text_hash")
    keyed = docs.withColumn(name, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(bad["doc_id"]) & (keyed[name] == bad["text_hash"])
    return keyed.join(bad, same, "left_anti").select(*(keyed[f"`{c}`"] for c in docs.columns))
