"""Repeated runs: changed partitions, hooks, byte copies and definitions that drift."""

import functools
import uuid

import pytest
from conftest import lay_out

from sluice import storage
from sluice.model import CopyPolicy, TableSpec
from sluice.operators import changes, copy, ledger, register
from sluice.plans.run import RunTarget, copy_tables
from sluice.session import new_scratch
from sluice.sources import files
from sluice.sources.tables import SourceTable, catalog_partitions, open_folder
from pyspark.sql import functions as F

NAME = "lake.monthly"


@pytest.fixture
def target(spark):
    root = new_scratch(spark, "run")
    database = f"db_{uuid.uuid4().hex}"
    register.create_database(spark, database, f"{root}/db")
    yield RunTarget(f"{root}/data", database, log=f"{root}/data/copy-log")
    spark.sql(f"DROP DATABASE {database} CASCADE")


def opened(spark, table, schema=None):
    return open_folder(spark, NAME, table.location, schema or table.frame.schema, ("month", "day"))


def flat(spark, rows):
    path = new_scratch(spark, "flat")
    spark.createDataFrame(rows, "id long, v string, m string").write.parquet(path)
    return path


def run(spark, table, target, policy=CopyPolicy(), hooks=(), **request):
    result = copy_tables(spark, {NAME: table}, [TableSpec(NAME, **request)], target, policy, hooks)
    assert result.errors == {}, result.errors
    return result


def read(spark, target):
    name = target.table_of(NAME)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def named_files(spark, path):
    return {(r["relative"], r["length"]) for r in files.list_files(spark, path).collect()}


def found(result):
    return {(r["name"], r["change"]) for r in result.changes[NAME].collect()}


@pytest.mark.parametrize("byte_copy", [True, False])
@pytest.mark.parametrize("in_place", [True, False])
def test_changed_partitions_alone_are_replaced(spark, monthly, target, monkeypatch, byte_copy, in_place):
    policy = CopyPolicy(byte_copy=byte_copy)
    run(spark, monthly, target, policy)
    path = target.table_path(NAME)
    before = named_files(spark, path)
    more = spark.createDataFrame([("c", 1, 1)] * 5 + [("d", 9, 9)], monthly.frame.schema)
    copy.write_partitioned(more, monthly.location, ["month", "day"], mode="append")
    storage.remove(spark, f"{monthly.location}/month=3/day=2")
    if not in_place:
        monkeypatch.setattr(storage, "renames_in_place", lambda spark, path: False)
    result = run(spark, opened(spark, monthly), target, policy)
    assert found(result) == {("month=1/day=1", "changed"), ("month=9/day=9", "added"), ("month=3/day=2", "gone")}
    rows = read(spark, target).groupBy("month", "day").count().collect()
    assert {(r["month"], r["day"]): r["count"] for r in rows} == {
        (1, 1): 7, (1, 2): 2, (2, 1): 2, (2, 2): 2, (3, 1): 2, (3, 2): 2, (9, 9): 1
    }
    after = named_files(spark, path)
    untouched = {f for f in before if not f[0].startswith("month=1/day=1/")}
    assert untouched <= after
    if byte_copy:
        assert after - untouched == {f for f in named_files(spark, monthly.location) if f[0].startswith(("month=1/day=1/", "month=9"))}
    # Nothing is left beside the copy, and a third run finds nothing to do.
    assert not [n for n in storage.child_names(spark, path.rpartition("/")[0]) if copy.STAGING_HINT in n]
    assert found(run(spark, opened(spark, monthly), target, policy)) == {("month=3/day=2", "gone")}
    assert named_files(spark, path) == after


def test_changed_partitions_are_reported_without_overwriting(spark, monthly, target):
    bound = RunTarget(target.folder, target.database, f"{target.folder}-ledger")
    policy = CopyPolicy(overwrite_if_exists=False)
    run(spark, monthly, RunTarget(target.folder, target.database), policy)
    copy.write_partitioned(monthly.frame.where("month = 2"), monthly.location, ["month", "day"], mode="append")
    for _ in range(2):
        result = copy_tables(spark, {NAME: opened(spark, monthly)}, [TableSpec(NAME)], RunTarget(target.folder, target.database), policy)
        assert found(result) == {("month=2/day=1", "changed"), ("month=2/day=2", "changed")}
        assert read(spark, target).count() == 12
    copy_tables(spark, {NAME: opened(spark, monthly)}, [TableSpec(NAME)], bound, policy)
    last = ledger.latest(ledger.open_ledger(spark, bound.ledger)).first()
    assert last["state"] == "finished" and last["message"].startswith("2 partitions changed")


@pytest.mark.parametrize("p", [1.0, 0.5])
def test_rows_tell_changes_of_a_table_that_is_not_laid_out(spark, target, p):
    rows = [(n, f"v{n}", f"m{n % 4}") for n in range(400)]
    path = flat(spark, rows)
    policy = CopyPolicy(sample_threshold=0, sample_keys={NAME: ("id",)})
    source = lambda: SourceTable(NAME, spark.read.parquet(path), ("m",))
    run(spark, source(), target, policy, sample_prob=p)
    before = named_files(spark, target.table_path(NAME))
    assert found(run(spark, source(), target, policy, sample_prob=p)) == set()
    # One value changes, one partition's rows go, one comes.
    kept = [(n, "changed" if n % 4 == 1 else v, m) for n, v, m in rows if m != "m2"] + [(1000 + n, "new", "m7") for n in range(50)]
    spark.createDataFrame(kept, "id long, v string, m string").write.mode("overwrite").parquet(path)
    result = run(spark, source(), target, policy, sample_prob=p)
    assert found(result) == {("m=m1", "changed"), ("m=m2", "gone"), ("m=m7", "added")}
    want = spark.createDataFrame(kept + [r for r in rows if r[2] == "m2"], "id long, v string, m string")
    want = want if p == 1 else want.where(copy.sample.sampled(p, ["id"], "md5"))
    assert sorted(map(tuple, read(spark, target).select("id", "v", "m").collect())) == sorted(map(tuple, want.collect()))
    after = named_files(spark, target.table_path(NAME))
    assert {f for f in before if f[0].startswith(("m=m0", "m=m3"))} <= after


def test_a_partition_whose_rows_are_gone_from_the_sample(spark, target):
    path = flat(spark, [(n, "v", f"m{n % 2}") for n in range(40)])
    policy = CopyPolicy(sample_threshold=0, sample_keys={NAME: ("id",)})
    source = lambda: SourceTable(NAME, spark.read.parquet(path), ("m",))
    hook = functools.partial(_without, value="m1")
    hook.version = "1"
    run(spark, source(), target, policy, [], sample_prob=0.9)
    run(spark, source(), target, policy, [hook], sample_prob=0.9)
    assert {r["m"] for r in read(spark, target).select("m").distinct().collect()} == {"m0"}


def _without(rows, value):
    return rows.where(F.col("m") != value)


def test_a_changed_hook_is_another_request(spark, monthly, target):
    policy = CopyPolicy(sample_threshold=0, sample_keys={NAME: ("name", "month", "day")})

    def masked(text):
        return lambda rows: rows.withColumn("name", F.lit(text))

    run(spark, monthly, target, policy, [masked("#")], sample_prob=0.9)
    assert {r["name"] for r in read(spark, target).collect()} == {"#"}
    run(spark, monthly, target, policy, [masked("*")], sample_prob=0.9)
    assert {r["name"] for r in read(spark, target).collect()} == {"*"}
    stay = CopyPolicy(sample_threshold=0, sample_keys=policy.sample_keys, overwrite_if_exists=False)
    result = copy_tables(spark, {NAME: monthly}, [TableSpec(NAME, sample_prob=0.9)], target, stay, [])
    assert "another request" in result.errors[NAME]
    again = copy_tables(spark, {NAME: monthly}, [TableSpec(NAME, sample_prob=0.9)], target, stay, [masked("*")])
    assert again.errors == {}


def test_identity_of_hooks():
    def make(value):
        def hook(rows):
            return [r for r in rows if r != value]

        return hook

    assert changes.identity(make(1)) == changes.identity(make(1))
    assert changes.identity(make(1)) != changes.identity(make(2))
    assert changes.identity(functools.partial(_without, value="a")) != changes.identity(functools.partial(_without, value="b"))

    class Callable:
        def __init__(self, value):
            self.value, self.other = value, object()

        def __call__(self, rows):
            return rows

    assert changes.identity(Callable(1)) == changes.identity(Callable(1)) != changes.identity(Callable(2))
    one, two = make(1), make(1)
    one.version, two.version = "a", "b"
    assert changes.identity(one) != changes.identity(two)


def test_new_and_wider_columns(spark, target):
    first = lay_out(spark, [(1, 1, 1), (2, 1, 2)], "n int, month int, day int", NAME)
    run(spark, first, target)
    schema = spark.createDataFrame([], "n long, extra string, month int, day int").schema
    more = spark.createDataFrame([(2**40, "x", 2, 1)], schema)
    copy.write_partitioned(more, first.location, ["month", "day"], mode="append")
    run(spark, opened(spark, first, schema), target)
    copied = read(spark, target)
    assert dict(copied.dtypes) == {"n": "bigint", "extra": "string", "month": "int", "day": "int"}
    assert sorted(map(tuple, copied.select("n", "extra", "month").collect()), key=str) == sorted(
        [(1, None, 1), (2, None, 1), (2**40, "x", 2)], key=str
    )
    # The log replays both versions, also twice.
    other = f"at_{uuid.uuid4().hex}"
    log = register.read_log(spark, target.log)
    for _ in range(2):
        register.attach(spark, log, storage.qualify(spark, target.folder), other)
        assert spark.table(f"{other}.monthly").count() == 3
        assert catalog_partitions(spark, f"{other}.monthly").count() == 3
    spark.sql(f"DROP DATABASE {other} CASCADE")


def test_a_new_column_alone_is_added_and_logged(spark, monthly, target):
    run(spark, monthly, target)
    schema = spark.createDataFrame([], "name string, extra double, month int, day int").schema
    copy.write_partitioned(spark.createDataFrame([("c", 0.5, 4, 1)], schema), monthly.location, ["month", "day"], mode="append")
    run(spark, opened(spark, monthly, schema), target)
    assert read(spark, target).where("extra = 0.5").count() == 1
    lines = [r["statement"] for r in register.read_log(spark, target.log).collect()]
    assert any(" add columns (`extra` double)" in line for line in lines)
    other = f"at_{uuid.uuid4().hex}"
    for _ in range(2):
        register.attach(spark, register.read_log(spark, target.log), storage.qualify(spark, target.folder), other)
        assert spark.table(f"{other}.monthly").where("extra = 0.5").count() == 1
    spark.sql(f"DROP DATABASE {other} CASCADE")


@pytest.mark.parametrize("schema", ["name int, month int, day int", "month int, day int", "name string, month string, day int"])
def test_other_drift_is_an_error_and_changes_nothing(spark, monthly, target, schema):
    run(spark, monthly, target)
    before = named_files(spark, target.table_path(NAME))
    copy.write_partitioned(monthly.frame.where("month = 1"), monthly.location, ["month", "day"], mode="append")
    drifted = opened(spark, monthly, spark.createDataFrame([], schema).schema)
    result = copy_tables(spark, {NAME: drifted}, [TableSpec(NAME)], target)
    assert "DefinitionDrift" in result.errors[NAME]
    assert named_files(spark, target.table_path(NAME)) == before
    assert dict(read(spark, target).dtypes)["name"] == "string"


def test_fingerprints_do_not_depend_on_order_and_take_maps(spark):
    frame = spark.createDataFrame([(1, {"a": 1, "b": 2}, None), (2, None, [1]), (1, {"a": 1, "b": 2}, None)], "k int, m map<string,int>, l array<int>")
    other = spark.createDataFrame([(2, None, [1]), (1, {"b": 2, "a": 1}, None), (1, {"a": 1, "b": 2}, None)], frame.schema)
    assert changes.changed_rows(frame, other, ["k"]).isEmpty()
    less = changes.changed_rows(frame.limit(2), other, ["k"])
    assert [r["name"] for r in less.collect()] == ["k=1"]
