import uuid

import pytest
from conftest import lay_out, names

from sluice import storage
from sluice.model import CopyPolicy, TableSpec
from sluice.operators import copy, ledger, register
from sluice.plans.run import RunTarget, copy_tables
from sluice.session import new_scratch
from sluice.sources.tables import (
    SourceTable,
    catalog_partitions,
    list_partitions,
    open_catalog,
    open_folder,
)


@pytest.fixture
def target(spark):
    root = new_scratch(spark, "run")
    database = f"db_{uuid.uuid4().hex}"
    register.create_database(spark, database, f"{root}/db")
    yield RunTarget(f"{root}/data", database, f"{root}/ledger", f"{root}/data/copy-log")
    spark.sql(f"DROP DATABASE {database} CASCADE")


def _states(spark, target):
    return {r["item"]: r["state"] for r in ledger.latest(ledger.open_ledger(spark, target.ledger)).collect()}


def test_nothing_configured_is_an_error(spark, target):
    with pytest.raises(ValueError, match="no source tables or files"):
        copy_tables(spark, {}, [], target)


def test_run_with_cap_copies_four_rows(spark, monthly, target):
    result = copy_tables(
        spark, {"lake.monthly": monthly}, [TableSpec("lake.monthly", partition_count=2)], target
    )
    assert result.modes == {"lake.monthly": "full"}
    assert spark.table(f"{target.database}.monthly").count() == 4
    log = register.describe_log(register.read_log(spark, target.log)).collect()
    assert len(log) == 3
    assert {r["state"]: r["items"] for r in result.report(spark).collect()} == {"finished": 1}


def test_failures_are_isolated_and_retried(spark, monthly, target):
    plain = SourceTable("lake.plain", spark.range(100).toDF("id"))
    sources = {"lake.monthly": monthly, "lake.plain": plain}
    specs = [
        TableSpec("lake.monthly", partitions=({"month": "2"},)),
        TableSpec("lake.plain"),
        TableSpec("lake.gone"),
    ]
    broken = [True]

    def hook(context):
        if context.source.name == "lake.plain" and broken[0]:
            raise RuntimeError("refused")

    policy = CopyPolicy(table_parallelism=3)
    first = copy_tables(spark, sources, specs, target, policy, after_copy=[hook])
    assert _states(spark, target) == {
        "lake.monthly": "finished",
        "lake.plain": "failed",
        "lake.gone": "invalid",
    }
    assert "refused" in first.errors["lake.plain"]
    assert spark.table(f"{target.database}.monthly").count() == 4
    broken[0] = False
    second = copy_tables(spark, sources, specs, target, policy, after_copy=[hook])
    assert set(second.tables) == {"lake.plain"}
    assert _states(spark, target)["lake.plain"] == "finished"
    assert _states(spark, target)["lake.gone"] == "invalid"
    assert spark.table(f"{target.database}.plain").count() == 100


def test_spec_without_partition_makes_the_table_invalid(spark, monthly, target):
    specs = [TableSpec("lake.monthly", partitions=({"month": "1"}, {"month": "7"}))]
    result = copy_tables(spark, {"lake.monthly": monthly}, specs, target)
    assert result.errors == {"lake.monthly": "spec has no partition: month=7"}
    assert _states(spark, target) == {"lake.monthly": "invalid"}


def test_a_repeated_run_adds_newer_partitions(spark, monthly, target):
    bare = RunTarget(target.folder, target.database)
    specs = [TableSpec("lake.monthly")]
    copy_tables(spark, {"lake.monthly": monthly}, specs, bare)
    more = spark.createDataFrame([("c", 4, 1)], monthly.frame.schema)
    copy.write_partitioned(more, monthly.location, ["month", "day"], mode="append")
    grown = open_folder(spark, monthly.name, monthly.location, monthly.frame.schema, ("month", "day"))
    copy_tables(spark, {"lake.monthly": grown}, specs, bare)
    name = f"{target.database}.monthly"
    assert "month=4/day=1" in names(catalog_partitions(spark, name))
    spark.catalog.refreshTable(name)
    assert spark.table(name).count() == 13


@pytest.mark.parametrize("in_place", [True, False])
def test_a_broken_copy_is_made_again(spark, monthly, target, monkeypatch, in_place):
    """With and without a cheap rename, half a copy is never taken for a whole one."""
    monkeypatch.setattr(storage, "renames_in_place", lambda spark, path: in_place)
    bare = RunTarget(target.folder, target.database)
    path = bare.table_path("lake.monthly")
    copy.write_partitioned(monthly.frame.where("month = 1"), path, ["month", "day"])
    copy_tables(spark, {"lake.monthly": monthly}, [TableSpec("lake.monthly")], bare)
    assert spark.table(f"{target.database}.monthly").count() == 12
    assert storage.exists(spark, f"{path}/_copied")
    again = copy_tables(spark, {"lake.monthly": monthly}, [TableSpec("lake.monthly")], bare)
    assert again.errors == {} and again.tables["lake.monthly"].frame.count() == 12


def test_existing_plain_copy_stays_without_overwrite(spark, target):
    bare = RunTarget(target.folder, target.database)
    policy = CopyPolicy(overwrite_if_exists=False)
    for rows, expected in ((10, 10), (20, 10)):
        source = SourceTable("lake.plain", spark.range(rows).toDF("id"))
        copy_tables(spark, {"lake.plain": source}, [TableSpec("lake.plain")], bare, policy)
        assert spark.read.parquet(bare.table_path("lake.plain")).count() == expected
    source = SourceTable("lake.plain", spark.range(20).toDF("id"))
    copy_tables(spark, {"lake.plain": source}, [TableSpec("lake.plain")], bare)
    assert spark.read.parquet(bare.table_path("lake.plain")).count() == 20


@pytest.mark.parametrize("byte_copy", [True, False])
@pytest.mark.parametrize("registered", [True, False])
def test_padded_folders_of_a_number_column(spark, target, byte_copy, registered):
    frame = spark.createDataFrame([("a", "02"), ("b", "10")], "name string, month string")
    path = new_scratch(spark, "padded")
    copy.write_partitioned(frame, path, ["month"])
    schema = spark.createDataFrame([], "name string, month int").schema
    source = open_folder(spark, "lake.padded", path, schema, ("month",))
    if registered:
        register.register_copy(spark, f"{target.database}.source", schema, ("month",), path)
        source = open_catalog(spark, f"{target.database}.source")
    result = copy_tables(
        spark, {"lake.padded": source}, [TableSpec("lake.padded")], target, CopyPolicy(byte_copy=byte_copy)
    )
    assert result.errors == {}
    rows = spark.table(f"{target.database}.padded").collect()
    assert sorted(map(tuple, rows)) == [("a", 2), ("b", 10)]


def test_sample_sizes_count_selected_partitions_only(spark, target):
    """A size target over the whole selection is a full copy, over a part of it a sample."""
    source = lay_out(spark, [(f"n{i}", i % 4 + 1, 1) for i in range(4000)], name="lake.big")
    from sluice.sources.tables import folder_partitions

    sizes = {r["name"]: r["bytes"] for r in folder_partitions(spark, source).collect()}
    one = sizes["month=4/day=1"]
    policy = CopyPolicy(sample_threshold=0, sample_keys={"lake.big": ("name",)})
    bare = RunTarget(target.folder, target.database)
    spec = TableSpec("lake.big", sample_size=one, partition_count=1)
    assert copy_tables(spark, {"lake.big": source}, [spec], bare, policy).modes == {"lake.big": "full"}
    other = RunTarget(target.folder + "2", target.database)
    spec = TableSpec("lake.big", sample_size=one)
    done = copy_tables(spark, {"lake.big": source}, [spec], other, policy)
    assert done.modes == {"lake.big": "sample"}
    kept = done.tables["lake.big"].frame.count()
    assert abs(kept - 1000) < 5 * (4000 * 0.25 * 0.75) ** 0.5 + 50


def test_loose_files(spark, target, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "testfile").write_text("1\n2\n")
    copy_tables(
        spark, {}, [], target, loose_files=[f"file:{tmp_path}/d/testfile", f"file:{tmp_path}/d"]
    )
    place = f"{target.folder}{tmp_path}/d/testfile"
    assert storage.exists(spark, place)
    assert spark.read.text(place).count() == 2
    lines = register.describe_log(register.read_log(spark, target.log)).collect()
    assert [r["data_type"] for r in lines] == ["hdfs", "hdfs"]
    assert all(r["line"].endswith(f"{tmp_path}/d/testfile") for r in lines)


def test_loose_files_that_fail_are_recorded(spark, monthly, target, tmp_path):
    """A missing loose source does not lose what the run has done."""
    result = copy_tables(
        spark, {"lake.monthly": monthly}, [TableSpec("lake.monthly")], target, loose_files=[f"file:{tmp_path}/gone"]
    )
    assert set(result.tables) == {"lake.monthly"} and set(result.errors) == {f"file:{tmp_path}/gone"}
    assert _states(spark, target) == {"lake.monthly": "finished", f"file:{tmp_path}/gone": "failed"}


def test_place_of_a_name_node_is_not_part_of_the_path(spark):
    for path in ("hdfs://nn:8020/data/x", "hdfs://nn/data/x", "file:/data/x", "/data/x"):
        spark.sparkContext._jsc.hadoopConfiguration().set("dfs.client.retry.max.attempts", "0")
        if path.startswith("hdfs") and "DistributedFileSystem" not in str(_file_system(spark, path)):
            continue
        assert storage.path_of(spark, path) == "/data/x"


def _file_system(spark, path):
    try:
        return storage._resolve(spark, path)[0]
    except Exception:  # no client for this scheme here
        return None


def test_two_requests_or_two_sources_for_one_copy_are_refused(spark, monthly, target):
    sources = {"a.t": monthly, "b.t": monthly}
    with pytest.raises(ValueError, match="two requests"):
        copy_tables(spark, sources, [TableSpec("a.t"), TableSpec("a.t", partition_count=1)], target)
    with pytest.raises(ValueError, match="would be one copy"):
        copy_tables(spark, sources, [TableSpec("a.t"), TableSpec("b.t")], target)
    assert not storage.exists(spark, target.folder)


def test_a_changed_request_without_overwriting_is_an_error(spark, monthly, target):
    bare = RunTarget(target.folder, target.database)
    policy = CopyPolicy(sample_threshold=0, overwrite_if_exists=False)
    sources = {"lake.monthly": monthly}
    first = copy_tables(spark, sources, [TableSpec("lake.monthly", sample_prob=0.5)], bare, policy)
    kept = sorted(map(tuple, first.tables["lake.monthly"].frame.collect()))
    again = copy_tables(spark, sources, [TableSpec("lake.monthly", sample_prob=1.0)], bare, policy)
    assert "another request" in again.errors["lake.monthly"]
    assert sorted(map(tuple, first.tables["lake.monthly"].frame.collect())) == kept
    same = copy_tables(spark, sources, [TableSpec("lake.monthly", sample_prob=0.5)], bare, policy)
    assert same.errors == {} and sorted(map(tuple, same.tables["lake.monthly"].frame.collect())) == kept


def test_a_sample_without_keys_is_the_same_in_every_run(spark, target):
    source = lay_out(spark, [(f"n{i}", i % 20, 1) for i in range(2000)], name="lake.big")
    policy = CopyPolicy(sample_threshold=0)
    rows = []
    for folder in ("x", "y"):
        bare = RunTarget(f"{target.folder}/{folder}", target.database)
        spec = [TableSpec("lake.big", sample_prob=0.1)]
        rows.append(sorted(map(tuple, copy_tables(spark, {"lake.big": source}, spec, bare, policy).tables["lake.big"].frame.collect())))
    assert rows[0] == rows[1] and 100 < len(rows[0]) < 320


def test_definition_goes_with_the_copy(spark, monthly, target):
    name = f"{target.database}.source"
    register.register_copy(
        spark, name, monthly.frame.schema, ("month", "day"), monthly.location, comment="it's", properties={"team": "us"}
    )
    copied = RunTarget(target.folder, target.database)
    copy_tables(spark, {"lake.copied": open_catalog(spark, name)}, [TableSpec("lake.copied")], copied)
    made = open_catalog(spark, f"{target.database}.copied")
    assert made.comment == "it's" and made.properties["team"] == "us"


def test_names_that_need_quotes(spark, target):
    frame = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, `order-id` string")
    path = new_scratch(spark, "odd")
    copy.write_partitioned(frame, path, ["order-id"])
    source = open_folder(spark, "lake.odd_name", path, frame.schema, ("order-id",))
    result = copy_tables(spark, {"lake.odd_name": source}, [TableSpec("lake.odd_name")], target)
    assert result.errors == {}
    other = f"db_{uuid.uuid4().hex}"
    base = storage.qualify(spark, target.folder)
    register.attach(spark, register.read_log(spark, target.log), base, other)
    assert spark.table(f"{other}.`odd_name`").count() == 2
    spark.sql(f"DROP DATABASE {other} CASCADE")


def test_empty_text_is_the_null_partition(spark, target):
    frame = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "name string, k string")
    listed = list_partitions(SourceTable("t", frame, ("k",)))
    assert sorted((r["name"], r["row_count"]) for r in listed.collect()) == [("k=__HIVE_DEFAULT_PARTITION__", 2), ("k=x", 1)]
