import pytest

import corpus_pipeline
from sluice.llm import bpe, decontaminate, line_dedup, quality, setsketch
from sluice.session import new_scratch
from llm.conftest import ODD, SCHEMA, sentence
from llm.test_bpe import library
from llm.test_decontaminate import brute as brute_hits
from llm.test_quality import prose
from llm.test_setsketch import brute as brute_groups

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark):
    """A folder of tables: clean texts, junk, copies, near copies and leaked passages."""
    path = new_scratch(spark, "tables")
    clean = [prose(n, 120).replace("the", f"the{n}", 3) for n in range(30)]
    near = [clean[n].replace(" ", f" z{n} ", 1) for n in range(6)]
    item = prose(700, 30)
    leaked = [prose(800 + n, 60) + "\n" + item + "\n" + prose(900 + n, 60) for n in range(3)]
    junk = [" ".join(w + "%%%" for w in prose(500 + n, 150).split()) for n in range(4)]
    texts = [*clean, *clean[10:14], *near, *leaked, *junk, *ODD]
    rows = [(n, t, "en", "s", len(t or "")) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages_in_order():
    assert list(STAGES) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe_round_trip"]


def test_each_stage_on_its_input(spark, folder, tokenizer):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    # Quality: what its report keeps, with all columns as they were.
    good = STAGES["quality_rules"](spark, docs, path)
    kept = {r["doc_id"] for r in quality.quality_report(docs).collect() if r["kept"]}
    rows = {r["doc_id"]: tuple(r) for r in good.collect()}
    assert good.columns == columns and set(rows) == kept
    assert set(range(30)) <= kept and not kept & set(range(43, 47))
    # Lines: the texts of the report, without documents that have none left.
    lines = STAGES["line_dedup"](spark, good, path)
    report = {r["doc_id"]: r for r in line_dedup.line_report(good).collect()}
    left = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert lines.columns == columns
    assert set(left) == {n for n, r in report.items() if r["n_removed"] < r["n_lines"]}
    assert not set(left) & set(range(30, 34)), "exact copies have no line left"
    # Near copies: the least document of each group, by comparing all pairs.
    ids = sorted(left)
    single = STAGES["near_dedup"](spark, lines, path)
    want = {d for d, _, group in brute_groups([left[n] for n in ids], ids, 5, 80) if d == group}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == want
    assert not want & set(range(34, 40))
    # Leaks: texts without a window of an item, by comparing all windows.
    ids = sorted(want)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    clean = STAGES["decontamination"](spark, single, path)
    want = {n for n, row in zip(ids, brute_hits([left[n] for n in ids], items)) if not row[-1]}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == want
    # Encoding: the library's numbers of tokens.
    own = bpe.Encoder(tokenizer)
    got = {r["doc_id"]: r["n_tokens"] for r in STAGES["bpe_round_trip"](spark, clean, path).collect()}
    ids = sorted(want)
    assert got == {n: len(x) for n, x in zip(ids, library(own, [left[n] for n in ids]))}


def test_whole_run(spark, folder):
    path, _ = folder
    done = corpus_pipeline.run(spark, path)
    assert set(range(30)) - {r["doc_id"] for r in done.collect()} == set()


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, folder):
    path, _ = folder
    rows = [(None, None, None, None, None), (1, "", "", "", 0), (2, prose(1, 80), None, None, None), (2, prose(1, 80), None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS text_hash", "'x' AS lines", "3 AS measured_text")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
        stage(spark, docs, path).collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == 4


def test_steps_of_a_stage_go_when_the_next_one_begins(spark, folder):
    """Written and read again, as run() does; steps that are still to be read stay."""
    from sluice import storage
    from sluice.session import handed_out

    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    corpus_pipeline._LEFT.clear()
    lines = STAGES["line_dedup"](spark, docs, path)
    left = list(corpus_pipeline._LEFT)
    assert left and all(f in handed_out() for f in left)
    STAGES["quality_rules"](spark, lines, path)
    assert all(f in handed_out() for f in left)
    written = new_scratch(spark, "written")
    lines.write.parquet(written)
    STAGES["quality_rules"](spark, spark.read.parquet(written), path)
    assert not any(f in handed_out() or storage.exists(spark, f) for f in left)
