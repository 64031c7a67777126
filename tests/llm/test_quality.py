import math
import random
import re

from sluice.llm import quality
from llm.conftest import ODD, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    spots = {}
    for i in range(len(words) - 2):
        spots.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(3)}
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(repeat), failed


def test_counts_equal_brute_force(spark, make_docs):
    draw = random.Random(4)
    texts = ODD + [" ".join(draw.choice("a b c d".split()) for _ in range(n)) for n in range(2, 90, 5)]
    texts += [sentence(n, 200, 8).replace("w1", "#\n<w|") for n in range(6)] + ["a b\na b\n \n\nc\na b\r\nc"]
    docs = make_docs(texts).selectExpr("*", "1 AS measured_text", "true AS kept")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for row in quality.quality_report(docs).collect():
        assert tuple(row[n] for n in names) == counts(texts[row["doc_id"]]), texts[row["doc_id"]]


def plain(text):
    left, sizes = text, []
    for pattern in quality.CLASSES.values():
        pattern = pattern.replace(r"\p{Ll}+", "[^\\W\\d_A-Z]+") if "p{" not in pattern else pattern
        import regex

        fresh = regex.sub(pattern, "", left)
        sizes.append(len(left) - len(fresh))
        left = fresh
    words = WORD.findall(text)
    common = [words.count(w) for w in quality.WORDS]
    return sizes + [len(left)], common + [len(words) - sum(common)]


def distance(counts, reference):
    n, m = sum(counts), sum(reference)
    total = 0.0
    for c, q in zip(counts, reference):
        p, q = c / n, q / m
        for a in (p, q):
            if a:
                total += a * math.log2(a / ((p + q) / 2)) / 2
    return math.sqrt(max(0.0, total))


def prose(seed, size):
    draw = random.Random(seed)
    common = "the of and to in is that for on with".split()
    return " ".join(draw.choice(common) if draw.random() < 0.4 else "".join(draw.choice("aeilnrst") for _ in range(draw.randrange(2, 9))) for _ in range(size)) + "."


def test_distances_and_verdicts(spark, make_docs):
    texts = [prose(n, 300) for n in range(30)]
    texts += [" ".join(w + "%%%" for w in prose(77, 200).split()), prose(78, 200).upper(), " ".join(f"{n} {n * 7}" for n in range(200))]
    texts += [prose(79, 60)]
    rows = {r["doc_id"]: r for r in quality.quality_report(make_docs(texts)).collect()}
    bins = [plain(t) for t in texts]
    sums = [[sum(b[k][i] for b in bins) for i in range(len(bins[0][k]))] for k in (0, 1)]
    for n, own in enumerate(bins):
        assert abs(rows[n]["class_distance"] - distance(own[0], sums[0])) < 1e-9
        assert abs(rows[n]["word_distance"] - distance(own[1], sums[1])) < 1e-9
    assert all(rows[n]["kept"] for n in range(30)) and rows[33]["kept"]
    assert not any(rows[n]["kept"] for n in (30, 31, 32))


def test_repetitive_hot_source_does_not_feed_references(spark, make_docs):
    texts = [prose(n, 300) for n in range(20)]
    junk = ["BUY NOW 24/7 %% " * 2000 + str(n) for n in range(10)]
    alone = {r["doc_id"]: r for r in quality.quality_report(make_docs(texts)).collect()}
    rows = {r["doc_id"]: r for r in quality.quality_report(make_docs(texts + junk)).collect()}
    for n in range(20):
        assert rows[n]["kept"] and abs(rows[n]["word_distance"] - alone[n]["word_distance"]) < 1e-9
    assert not any(rows[n]["kept"] for n in range(20, 30))


def test_no_reference_no_rows_own_columns(spark, make_docs):
    docs = make_docs([sentence(1, 80, 10**6), None]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "1 AS measured_kept")
    rows = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    assert rows[0]["kept"] and rows[0]["class_distance"] is None and not rows[1]["kept"]
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 1
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark, make_docs):
    text = quality.quality_report(make_docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_languages_without_a_reference_are_not_judged_by_others(spark):
    """Clean texts of an unlisted language and script stay; word salad of a listed one goes."""
    draw = random.Random(4)
    common = {"en": "the of and to in is that for on with", "it": "di che la il un per non una sono con", "ru": "и в не на я что он с как это"}
    rare = {"en": "house tree river stone", "it": "casa albero fiume pietra", "ru": "дом дерево река камень"}

    def text(lang, share):
        words = [draw.choice((common if draw.random() < share else rare)[lang].split()) + str(n % 7) * (n % 11 == 0) for n in range(300)]
        return " ".join(words)

    rows = [(n, text(lang, 0.4), lang) for n, lang in enumerate(["en"] * 30 + ["it"] * 10 + ["ru"] * 10)]
    rows += [(100 + n, text("en", 0.0), "en") for n in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.quality_report(docs).collect() if r["kept"]}
    assert kept == set(range(50))


def test_kept_rows_are_not_measured_by_a_filter(spark, make_docs):
    """A filter on the verdict would compute all counts again for each use."""
    found = quality.keep_good(make_docs([None, "a b"]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.lstrip(" :+-").startswith("Filter") for line in plan.splitlines()), plan
    assert found.columns == make_docs([]).columns
