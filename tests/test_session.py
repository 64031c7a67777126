from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sluice import session, storage


class FakeConf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def fake(master, **conf):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=FakeConf(conf), sparkContext=context)


def test_scratch_is_the_shared_folder():
    spark = fake("yarn", **{"spark.checkpoint.dir": "hdfs://node/tmp/"})
    assert session.scratch_root(spark) == "hdfs://node/tmp"
    assert session.new_scratch(spark, "x").startswith("hdfs://node/tmp/sluice-x-")
    session._HANDED_OUT.pop()


def test_a_cluster_needs_the_setting():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(fake("yarn"))


def test_a_local_session_may_use_a_folder_of_its_own():
    spark = fake("local[2]")
    root = session.scratch_root(spark)
    assert session.scratch_root(spark) == root


def test_pinned_frames_are_sized_and_whole(spark):
    pinned = session.pin(spark.range(100).select("id", F.lit("x").alias("t")))
    assert pinned.count() == 100
    plan = spark.range(10_000_000).join(pinned.select("id"), "id", "left_semi")
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_local_rows_are_sized(spark):
    rows = session.local_rows(spark, [(1, "a"), (2, None)], "i int, t string")
    assert "LocalTableScan" in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in rows.collect()] == [(1, "a"), (2, None)]
    assert session.local_rows(spark, [], "i int").count() == 0


def test_object_stores_are_known(spark, monkeypatch):
    assert storage.renames_in_place(spark, "/tmp/x")
    monkeypatch.setattr(storage, "qualify", lambda spark, path: path)
    assert not storage.renames_in_place(spark, "s3a://bucket/x")
    assert storage.renames_in_place(spark, "hdfs://node/x")
