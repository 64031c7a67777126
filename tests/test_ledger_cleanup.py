import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from conftest import names

from sluice import storage
from sluice.model import LEDGER_SCHEMA, CopyPolicy, TableSpec
from sluice.operators import cleanup, copy, ledger, register, registry
from sluice.session import local_rows, new_scratch
from sluice.sources.tables import catalog_partitions

EARLY, LATE = datetime(1970, 1, 1, 0, 0, 1), datetime(1970, 1, 1, 0, 0, 2)
STATES = {"db.t1": "finished", "db.t2": "finished", "db.t3": "todo", "db.t0": "failed", "db.t4": "invalid"}


def _ledger(spark):
    rows = [(item, "todo", EARLY, 0, None) for item in STATES]
    rows += [(item, state, LATE, 90, None) for item, state in STATES.items()]
    return local_rows(spark, rows, LEDGER_SCHEMA)


def test_next_run(spark):
    configured = local_rows(spark, [(f"db.t{i}",) for i in range(6)], "item string")
    run = ledger.next_run(configured, _ledger(spark))
    assert sorted(r["item"] for r in ledger.attempts(run).collect()) == ["db.t0", "db.t3", "db.t5"]
    assert {r["item"]: r["state"] for r in run.collect()} == {
        "db.t0": "todo",
        "db.t1": "finished",
        "db.t2": "finished",
        "db.t3": "todo",
        "db.t4": "invalid",
        "db.t5": "todo",
    }


def test_items_no_longer_configured_drop_out(spark):
    run = ledger.next_run(local_rows(spark, [("db.t5",)], "item string"), _ledger(spark))
    assert {r["item"]: r["before"] for r in run.collect()} == {
        "db.t1": "finished",
        "db.t2": "finished",
        "db.t4": "invalid",
        "db.t5": "new",
    }


def test_report(spark):
    rows = {r["state"]: r for r in ledger.report(_ledger(spark)).collect()}
    assert rows["finished"]["items"] == 2
    assert rows["finished"]["elapsed"] == "0:03:00"
    totals = ledger.run_totals(_ledger(spark)).first()
    assert (totals["success"], totals["failure"], totals["invalid"]) == (2, 1, 1)


def test_concurrent_records_are_all_kept(spark):
    path = new_scratch(spark, "ledger")
    assert ledger.open_ledger(spark, path).isEmpty()
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: ledger.record(spark, path, [(f"t{i}", "finished", LATE, 1, None)]), range(16)))
    assert ledger.latest(ledger.open_ledger(spark, path)).count() == 16


@pytest.fixture
def copies(spark, monthly):
    database = f"db_{uuid.uuid4().hex}"
    register.create_database(spark, database, new_scratch(spark, "db"))
    for name in ("a", "b"):
        done = copy.full_copy(spark, monthly, new_scratch(spark, name))
        register.register_copy(spark, f"{database}.{name}", done.frame.schema, ("month", "day"), done.location)
    plain = new_scratch(spark, "plain")
    spark.range(5).write.parquet(plain)
    register.register_copy(spark, f"{database}.plain", spark.range(5).schema, (), plain)
    yield database
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_cleanup_by_cap_and_spec(spark, copies):
    outcome = cleanup.cleanup(
        spark,
        [
            TableSpec(f"{copies}.a", partition_count=2),
            TableSpec(f"{copies}.b", partitions=({"day": "1"},)),
            TableSpec(f"{copies}.gone"),
            TableSpec(f"{copies}.plain", skip_cleanup=True),
        ],
        CopyPolicy(),
    )
    assert outcome[f"{copies}.a"] == "dropped 2 partitions"
    assert outcome[f"{copies}.plain"] == "kept"
    assert outcome[f"{copies}.gone"].startswith("invalid")
    assert names(catalog_partitions(spark, f"{copies}.a")) == [
        f"month={m}/day={d}" for m in (1, 2) for d in (1, 2)
    ]
    assert names(catalog_partitions(spark, f"{copies}.b")) == [f"month={m}/day=2" for m in (1, 2, 3)]
    assert spark.table(f"{copies}.a").count() == 8
    assert spark.table(f"{copies}.plain").count() == 5


def test_cleanup_deletes_folders_and_keeps_others(spark, copies):
    from sluice.sources.tables import open_catalog

    location = open_catalog(spark, f"{copies}.a").location
    cleanup.cleanup(spark, [TableSpec(f"{copies}.a", partition_count=2)], CopyPolicy())
    assert not storage.exists(spark, f"{location}/month=3/day=1")
    assert storage.exists(spark, f"{location}/month=2/day=2")


def test_cleanup_finds_padded_folders(spark, copies):
    frame = spark.createDataFrame([("a", "02"), ("b", "10")], "name string, month string")
    path = new_scratch(spark, "padded")
    copy.write_partitioned(frame, path, ["month"])
    schema = spark.createDataFrame([], "name string, month int").schema
    register.register_copy(spark, f"{copies}.padded", schema, ("month",), path)
    spec = TableSpec(f"{copies}.padded", partitions=({"month": "2"},))
    assert cleanup.cleanup(spark, [spec], CopyPolicy())[spec.name] == "dropped 1 partitions"
    assert storage.child_names(spark, path) == ["month=10"]


def test_whole_table_drop_needs_a_flag(spark, copies):
    name = f"{copies}.a"
    assert cleanup.cleanup(spark, [TableSpec(name)], CopyPolicy())[name] == "dropped 6 partitions"
    assert spark.catalog.tableExists(name)
    assert cleanup.cleanup(spark, [TableSpec(name)], CopyPolicy())[name] == "dropped 0 partitions"
    assert cleanup.cleanup(spark, [TableSpec(name)], CopyPolicy(), True)[name] == "dropped table"
    assert not spark.catalog.tableExists(name)
    plain = f"{copies}.plain"
    assert cleanup.cleanup(spark, [TableSpec(plain)], CopyPolicy())[plain] == "dropped table"


def test_parents_and_children(spark):
    parents = spark.createDataFrame([("p1",), ("p2",)], "id string")
    children = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c2", "p1"), ("c3", "px")], "c string, p string")
    rows = {r["parent"]: r for r in registry.rollup_children(parents, children, "id", "p", "c").collect()}
    assert (rows["p1"]["kind"], rows["p1"]["children"], rows["p1"]["members"]) == ("matched", 3, 2)
    assert (rows["p2"]["kind"], rows["p2"]["children"]) == ("childless", 0)
    assert rows["px"]["kind"] == "orphan"
    members = registry.child_members(parents, children, "id", "p", "c").collect()
    assert sorted(tuple(r) for r in members) == [("p1", "c1"), ("p1", "c2")]
    assert [r["c"] for r in registry.orphans(parents, children, "id", "p").collect()] == ["c3"]


def test_one_failure_does_not_stop_cleanup(spark, monthly):
    database = f"db_{uuid.uuid4().hex}"
    register.create_database(spark, database, new_scratch(spark, "db"))
    spark.sql(f"CREATE VIEW {database}.view AS SELECT 1 AS x")
    register.register_copy(spark, f"{database}.monthly", monthly.frame.schema, ("month", "day"), monthly.location)
    done = cleanup.cleanup(spark, [TableSpec(f"{database}.view"), TableSpec(f"{database}.monthly")], CopyPolicy())
    assert done[f"{database}.view"].startswith(("failed", "invalid"))
    assert done[f"{database}.monthly"] == "dropped 6 partitions"
    spark.sql(f"DROP DATABASE {database} CASCADE")
