import pytest
from pyspark.sql import functions as F

from sluice.model import SUMMARY_SCHEMA, CopyPolicy, TableSpec
from sluice.operators import sample
from sluice.session import local_rows


def _ids(df):
    return {r["id"] for r in df.select("id").collect()}


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_sample_depends_on_keys_only(spark, method):
    df = spark.range(20_000)
    kept = _ids(sample.bernoulli_sample(df, 0.1, ["id"], method))
    again = _ids(sample.bernoulli_sample(df.repartition(7), 0.1, ["id"], method))
    assert kept == again
    assert abs(len(kept) - 2000) < 5 * (20_000 * 0.1 * 0.9) ** 0.5
    assert _ids(sample.bernoulli_sample(df, 0.03, ["id"], method)) <= kept


@pytest.mark.parametrize("method", ["md5", "xxhash64", "rand"])
def test_edges(spark, method):
    df = spark.range(100)
    assert sample.bernoulli_sample(df, 0.0, ["id"], method).count() == 0
    assert sample.bernoulli_sample(df, -1.0, ["id"], method).count() == 0
    assert sample.bernoulli_sample(df, 1.0, ["id"], method).count() == 100
    assert sample.bernoulli_sample(df, 0.99999999999, ["id"], method).count() > 0


def test_threshold_text():
    assert sample.threshold_hex(0.5) == "80000000"
    assert sample.threshold_hex(1 / 2**32) == "0000000100000000"
    assert sample.threshold_hex(2**-16) == "00010000"
    assert int(sample.threshold_hex(1e-12), 16) > 0
    assert sample.threshold_hex(0.9999999999999999) == "ffffffff"


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_small_probabilities(spark, method):
    df = spark.range(3_000_000)
    kept = _ids(sample.bernoulli_sample(df, 1e-5, ["id"], method))
    assert abs(len(kept) - 30) <= 5 * 30**0.5
    assert kept <= _ids(sample.bernoulli_sample(df, 2e-5, ["id"], method))
    assert _ids(sample.bernoulli_sample(df, 1e-6, ["id"], method)) <= kept


def test_bad_methods(spark):
    with pytest.raises(ValueError):
        sample.sampled(0.5, [])
    with pytest.raises(ValueError):
        sample.sampled(0.5, ["id"], "crc")


def test_rand_keeps_its_share(spark):
    kept = sample.bernoulli_sample(spark.range(50_000), 0.2, method="rand", seed=3).count()
    row = spark.range(1).select(sample.in_sigma_band(F.lit(50_000), F.lit(kept), 0.2)).first()
    assert row[0]


REQUESTS = [
    TableSpec("log.t1", sample_prob=0.02, partitions=({"day": "2017-05-01", "platform": "2"},)),
    TableSpec("log.t2", sample_prob=0.1, sample_size=500, skip_cleanup=True),
    TableSpec("db.t3", partition_count=3),
    TableSpec("db.gone", sample_prob=0.5),
]
POLICY = CopyPolicy(sample_threshold=10_241_024)


def _decide(spark, size, policy=POLICY):
    rows = [(s.name, size, 1, 1, None) for s in REQUESTS[:3]]
    summary = local_rows(spark, rows, SUMMARY_SCHEMA)
    frame = sample.resolve_policy(summary, sample.requests_frame(spark, REQUESTS), policy)
    return {r["name"]: r for r in frame.collect()}


def test_policy_order(spark):
    rows = _decide(spark, 20_000_000)
    assert rows["log.t1"]["probability"] == 0.02
    assert rows["log.t2"]["probability"] == 500 / 20_000_000
    assert rows["db.t3"]["probability"] == 0.01
    assert {rows[n]["mode"] for n in ("log.t1", "log.t2", "db.t3")} == {"sample"}
    assert rows["db.t3"]["partition_count"] == 3
    assert rows["log.t1"]["partition_count"] == -1
    assert rows["log.t2"]["skip_cleanup"] and not rows["log.t1"]["skip_cleanup"]
    assert rows["db.gone"]["error"] == "table not found: db.gone"
    assert rows["db.gone"]["mode"] is None


def test_small_tables_are_whole(spark):
    assert {r["mode"] for n, r in _decide(spark, 10_000_000).items() if n != "db.gone"} == {"full"}


def test_empty_table_is_whole(spark):
    rows = _decide(spark, 0, CopyPolicy(sample_threshold=-1))
    assert rows["log.t2"]["mode"] == "full"
    assert rows["log.t2"]["probability"] == float("inf")
    assert rows["log.t1"]["mode"] == "sample"


def test_default_size_beats_default_probability(spark):
    rows = _decide(spark, 20_000_000, CopyPolicy(default_size=1_000_000, sample_threshold=0))
    assert rows["db.t3"]["probability"] == 0.05
    assert rows["log.t1"]["probability"] == 0.02
