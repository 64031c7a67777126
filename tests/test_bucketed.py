"""Copies that keep buckets: their plans, rows and definitions."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from sluice.operators import register
from sluice.operators.bucketed import Buckets, bucketed_copy, buckets_of
from sluice.operators.sample import bernoulli_sample
from sluice.session import new_scratch
from sluice.sources.tables import SourceTable, catalog_partitions

KEYS = ("id", "month")


@pytest.fixture
def database(spark):
    name = f"db_{uuid.uuid4().hex}"
    register.create_database(spark, name, new_scratch(spark, "db"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


@pytest.fixture
def source(spark, database):
    """A registered table of 4 buckets in 3 months."""
    frame = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("v"), (F.col("id") % 3).cast("string").alias("month"))
    flat = SourceTable("flat", frame, ("month",), comment="with ' and LOCATION 'x'")
    path = new_scratch(spark, "made")
    return bucketed_copy(spark, flat, f"{database}.made", path, buckets=Buckets(4, ("id",), ("id",)))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("p", [1.0, 0.3])
def test_joins_and_groups_without_an_exchange(spark, database, source, p):
    made = bucketed_copy(spark, source, f"{database}.copied", new_scratch(spark, "copied"), p, KEYS)
    assert buckets_of(spark, made.name) == Buckets(4, ("id",), ("id",))
    wanted = bernoulli_sample(source.frame, p, KEYS)
    assert made.frame.count() == wanted.count() and made.frame.exceptAll(wanted).isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = made.frame.alias("a").join(source.frame.alias("b"), "id").select("a.id", "b.v")
        grouped = made.frame.groupBy("id").count()
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert "Exchange" not in plan(grouped)
        assert joined.count() == wanted.count()
        # Without this the scan prunes too, but its plan does not say so.
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        one = spark.table(made.name).where("id = 77")
        assert re.search(r"SelectedBucketsCount: 1 out of 4", plan(one))
        assert one.count() == wanted.where("id = 77").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_chosen_partitions_and_replacement(spark, database, source):
    path, name = new_scratch(spark, "copied"), f"{database}.copied"
    chosen = catalog_partitions(spark, source.name).where("month = '1'")
    made = bucketed_copy(spark, source, name, path, chosen=chosen)
    assert made.frame.count() == 1000
    assert [r["name"] for r in catalog_partitions(spark, name).collect()] == ["month=1"]
    with pytest.raises(FileExistsError):
        bucketed_copy(spark, source, name, path)
    whole = bucketed_copy(spark, source, name, path, overwrite=True, buckets=Buckets(2, ("v",)))
    assert whole.frame.count() == 3000 and buckets_of(spark, name) == Buckets(2, ("v",))
    assert whole.comment == source.comment
    left = [t.name for t in spark.catalog.listTables(database)]
    assert sorted(left) == ["copied", "made"]


def test_what_has_no_buckets_is_refused(spark, database, source):
    with pytest.raises(ValueError, match="not bucketed"):
        bucketed_copy(spark, SourceTable("flat", source.frame), f"{database}.x", new_scratch(spark, "x"))
    with pytest.raises(ValueError, match="partition column"):
        bucketed_copy(spark, source, f"{database}.x", new_scratch(spark, "x"), buckets=Buckets(2, ("month",)))
