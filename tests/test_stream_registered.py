"""A stream and batch runs that share one registered copy."""

import uuid

import pytest
from conftest import lay_out

from sluice.model import CopyPolicy, TableSpec
from sluice.operators import copy, register
from sluice.plans.run import RunTarget, copy_tables
from sluice.session import new_scratch
from sluice.sources import files
from sluice.sources.tables import catalog_partitions, open_folder
from sluice.streaming.registered import stream_into_copy

NAME = "lake.monthly"


@pytest.fixture
def target(spark):
    root = new_scratch(spark, "run")
    database = f"db_{uuid.uuid4().hex}"
    register.create_database(spark, database, f"{root}/db")
    yield RunTarget(f"{root}/data", database, ledger=f"{root}/ledger", log=f"{root}/data/copy-log")
    spark.sql(f"DROP DATABASE {database} CASCADE")


def add(spark, table, rows):
    frame = spark.createDataFrame(rows, table.frame.schema)
    copy.write_partitioned(frame, table.location, list(table.partition_columns), mode="append")


def rows(spark, target):
    name = target.table_of(NAME)
    spark.catalog.refreshTable(name)
    return sorted(tuple(r) for r in spark.table(name).collect())


def expected(spark, table):
    fresh = open_folder(spark, NAME, table.location, table.frame.schema, ("month", "day"))
    return sorted(tuple(r) for r in fresh.frame.collect())


def listed(spark, target):
    found = files.list_files(spark, target.table_path(NAME), times=True)
    return {(r["relative"], r["length"], r["modified"]) for r in found.collect()}


def test_batch_stream_batch_and_replay(spark, monthly, target):
    state = new_scratch(spark, "state")
    whole = [TableSpec(NAME, sample_prob=1.0)]
    bound = RunTarget(target.folder, target.database, log=target.log)

    def batch():
        fresh = open_folder(spark, NAME, monthly.location, monthly.frame.schema, ("month", "day"))
        assert copy_tables(spark, {NAME: fresh}, whole, bound).errors == {}

    batch()
    before = listed(spark, target)
    assert stream_into_copy(spark, monthly, target, state) >= 1
    assert listed(spark, target) == before
    add(spark, monthly, [("c", 1, 1), ("d", 9, 9)])
    assert stream_into_copy(spark, monthly, target, state) == 1
    assert rows(spark, target) == expected(spark, monthly)
    kept = listed(spark, target)
    assert {f for f in before if "month=1/day=1" not in f[0]} <= kept
    assert "month=9/day=9" in {r["name"] for r in catalog_partitions(spark, target.table_of(NAME)).collect()}
    # A lost checkpoint replays every file.
    assert stream_into_copy(spark, monthly, target, new_scratch(spark, "state"), max_files_per_batch=3) > 1
    assert listed(spark, target) == kept
    add(spark, monthly, [("e", 2, 2)])
    batch()
    assert rows(spark, target) == expected(spark, monthly)
    after = listed(spark, target)
    stream_into_copy(spark, monthly, target, state)
    assert listed(spark, target) == after


def test_failed_batch_is_tried_again(spark, monthly, target):
    state, calls = new_scratch(spark, "state"), []
    policy = CopyPolicy(sample_keys={NAME: ("name",)})

    def hook(found):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("died")
        return found

    with pytest.raises(Exception, match="died"):
        stream_into_copy(spark, monthly, target, state, 0.999999, policy, [hook])
    stream_into_copy(spark, monthly, target, state, 0.999999, policy, [hook])
    assert rows(spark, target) == expected(spark, monthly)


def test_other_requests_and_sources_are_refused(spark, monthly, target):
    bound = RunTarget(target.folder, target.database)
    assert copy_tables(spark, {NAME: monthly}, [TableSpec(NAME, sample_prob=1.0)], bound).errors == {}
    policy = CopyPolicy(sample_keys={NAME: ("name",)})
    with pytest.raises(Exception, match="another request"):
        stream_into_copy(spark, monthly, target, new_scratch(spark, "state"), 0.5, policy)
    assert rows(spark, target) == expected(spark, monthly)
    with pytest.raises(ValueError, match="repeatable"):
        stream_into_copy(spark, monthly, target, "x", 0.5, CopyPolicy(sample_method="rand"))


def test_null_and_padded_partitions(spark, target):
    table = lay_out(spark, [("a", "01", None), ("b", "02", "x y/z"), ("c", "02", "")], "name string, month string, day string")
    stream_into_copy(spark, table, target, new_scratch(spark, "state"))
    assert [r[0] for r in rows(spark, target)] == ["a", "b", "c"]
    names = {r["name"] for r in catalog_partitions(spark, target.table_of(NAME)).collect()}
    assert "month=02/day=x y%2Fz" in names and len(names) == 3
