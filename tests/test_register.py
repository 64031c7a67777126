import uuid

import pytest
from conftest import names
from pyspark.sql import functions as F

from sluice.model import UnresolvedRequest
from sluice.operators import copy, register
from sluice.session import local_rows, new_scratch
from sluice.sources import files
from sluice.sources.formats import PARQUET, delimited, from_hive_clause, from_input_format, from_serde
from sluice.sources.tables import (
    catalog_partitions,
    folder_partitions,
    located_partitions,
    open_catalog,
    open_folder,
    partition_location,
)


@pytest.fixture
def database(spark):
    name = f"db_{uuid.uuid4().hex}"
    register.create_database(spark, name, new_scratch(spark, "db"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_register_is_repeatable(spark, monthly, database):
    name = f"{database}.monthly"
    for _ in range(2):
        register.register_copy(spark, name, monthly.frame.schema, ("month", "day"), monthly.location)
        assert spark.table(name).count() == 12
    table = open_catalog(spark, name)
    assert table.partition_columns == ("month", "day")
    assert table.storage == PARQUET
    assert table.location.endswith(monthly.location.rpartition("/")[2])
    assert "PARTITIONED BY (month, day)" in spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
    assert names(catalog_partitions(spark, name, {"month": "2"})) == ["month=2/day=1", "month=2/day=2"]
    with pytest.raises(UnresolvedRequest):
        catalog_partitions(spark, name, {"month": "9"})
    with pytest.raises(UnresolvedRequest):
        open_catalog(spark, f"{database}.gone")


def test_empty_partition_is_registered(spark, monthly, database):
    name = f"{database}.monthly"
    register.register_copy(spark, name, monthly.frame.schema, ("month", "day"), monthly.location)
    extra = local_rows(spark, [(12, 1, "month=12/day=1")], "month int, day int, name string")
    for _ in range(2):
        assert register.add_partitions(spark, name, extra, ["month", "day"], monthly.location) == 1
    assert "month=12/day=1" in names(catalog_partitions(spark, name))
    assert spark.table(name).count() == 12


def test_located_partitions(spark, monthly, database):
    name = f"{database}.monthly"
    register.register_copy(spark, name, monthly.frame.schema, ("month", "day"), monthly.location)
    extra = local_rows(spark, [(12, 1, "month=12/day=1")], "month int, day int, name string")
    register.add_partitions(spark, name, extra, ["month", "day"], monthly.location)
    rows = {r["name"]: r for r in located_partitions(spark, open_catalog(spark, name)).collect()}
    assert len(rows) == 7
    assert rows["month=12/day=1"]["bytes"] == 0
    assert rows["month=3/day=1"]["bytes"] > 0
    for key in ("month=12/day=1", "month=3/day=1"):
        spec = dict(part.split("=") for part in key.split("/"))
        assert partition_location(spark, name, spec) == rows[key]["location"]


def test_padded_folders_of_a_number_column(spark, database):
    frame = spark.createDataFrame([("a", "02"), ("b", "10")], "name string, month string")
    path = new_scratch(spark, "padded")
    copy.write_partitioned(frame, path, ["month"])
    schema = spark.createDataFrame([], "name string, month int").schema
    register.register_copy(spark, f"{database}.t", schema, ("month",), path)
    rows = {r["month"]: r for r in located_partitions(spark, open_catalog(spark, f"{database}.t")).collect()}
    assert rows[2]["location"].endswith("month=02") and rows[2]["bytes"] > 0


def test_delimited_table_keeps_its_options(spark, database):
    """A copy of a text table is written and registered with the source's delimiters."""
    kind = delimited(fields=";", escape="!", null="~")
    schema = spark.createDataFrame([], "name string, n int, month string").schema
    schema["name"].metadata["comment"] = "who's who"
    frame = spark.createDataFrame([("a;b", 1, "01"), (None, None, "02"), ("", 3, "02")], schema)
    path, target = new_scratch(spark, "text"), new_scratch(spark, "copy")
    copy.write_partitioned(frame, path, ["month"], storage=kind)
    register.register_copy(spark, f"{database}.a", schema, ("month",), path, kind)
    source = open_catalog(spark, f"{database}.a")
    assert source.storage == kind
    done = copy.full_copy(spark, source, target)
    register.register_copy(spark, f"{database}.b", source.frame.schema, ("month",), target, done.storage)
    assert sorted(map(tuple, spark.table(f"{database}.b").collect()), key=str) == sorted(
        map(tuple, frame.collect()), key=str
    )
    assert spark.table(f"{database}.b").schema["name"].metadata["comment"] == "who's who"


def test_hive_format_names():
    assert from_hive_clause("orc").source == "orc"
    assert from_input_format("org.apache.hadoop.hive.ql.io.orc.OrcInputFormat").source == "orc"
    lazy = from_serde(
        "org.apache.hadoop.hive.serde2.lazy.LazySimpleSerDe",
        {"field.delim": "\t", "escape.delim": ";", "line.delim": "c", "serialization.null.format": "' '"},
    )
    assert lazy.source == "csv"
    assert [lazy.options[k] for k in ("sep", "escape", "lineSep", "nullValue")] == ["\t", ";", "c", "' '"]
    for unknown in (from_hive_clause, from_input_format, from_serde):
        with pytest.raises(ValueError, match="RCFILE"):
            unknown("RCFILE")


def test_create_like(spark, monthly, database):
    register.register_copy(
        spark, f"{database}.a", monthly.frame.schema, ("month", "day"), monthly.location
    )
    register.create_like(spark, f"{database}.b", f"{database}.a", new_scratch(spark, "like"))
    assert spark.table(f"{database}.b").schema == spark.table(f"{database}.a").schema
    assert spark.table(f"{database}.b").count() == 0


def test_log_and_attach(spark, monthly, database):
    """Months 2 and 3 are shared with a loose file; another database attaches to them."""
    root = new_scratch(spark, "shared")
    log = f"{root}/copy-log"
    folder = f"{root}/lake/monthly"
    copy.write_partitioned(monthly.frame.where("month > 1"), folder, ["month", "day"])
    shared = open_folder(spark, "monthly", folder, monthly.frame.schema, ("month", "day"))
    statements = register.table_statements(
        folder_partitions(spark, shared),
        "lake",
        "monthly",
        monthly.frame.schema,
        ["month", "day"],
        F.concat(F.lit("hdfs://node/lake/monthly/"), F.col("name")),
    )
    register.append_log(statements, log)
    loose = spark.createDataFrame([("tmp/testfile",)], "relative string")
    register.append_log(register.file_statements(loose, "s3a://shared"), log, register.FILES)

    described = register.describe_log(register.read_log(spark, log))
    rows = described.collect()
    assert [r["data_type"] for r in rows] == ["hive"] * 5 + ["hdfs"]
    assert rows[0]["line"].startswith("CREATE TABLE IF NOT EXISTS `monthly`")
    assert rows[1]["line"] == "alter table `monthly` add if not exists partition (`month`=2, `day`=1) "
    assert rows[5]["line"] == "s3a://shared/tmp/testfile"
    assert not any("ocation" in r["line"] for r in rows)

    calls = register.attach(spark, register.read_log(spark, log), root, database)
    assert calls == 3  # use, create table, one call for all partitions
    register.attach(spark, register.read_log(spark, log), root, database)
    name = f"{database}.monthly"
    assert names(catalog_partitions(spark, name)) == [f"month={m}/day={d}" for m in (2, 3) for d in (1, 2)]
    assert register.run_statements(spark, [f"SELECT count(*) AS n FROM {name}"]).first()["n"] == 8
    assert spark.catalog.currentDatabase() == "default"


def test_awkward_partition_values_survive_the_log(spark, database):
    values = ["it's", "back\\slash", "a=b/c", "50%", None]
    frame = spark.createDataFrame([(i, v, i) for i, v in enumerate(values)], "i int, k string, n int")
    root = new_scratch(spark, "shared")
    folder = f"{root}/lake/t"
    copy.write_partitioned(frame, folder, ["k", "n"])
    shared = open_folder(spark, "t", folder, frame.schema, ("k", "n"))
    statements = register.table_statements(
        folder_partitions(spark, shared), "lake", "t", frame.schema, ["k", "n"],
        F.concat(F.lit("/lake/t/"), F.col("name")),
    )
    register.append_log(statements, f"{root}/copy-log")
    register.attach(spark, register.read_log(spark, f"{root}/copy-log"), root, database)
    assert sorted(map(tuple, spark.table(f"{database}.t").collect())) == sorted(map(tuple, frame.collect()))
    listed = catalog_partitions(spark, f"{database}.t")
    register.add_partitions(spark, f"{database}.t", listed, ["k", "n"], folder)
    assert listed.count() == 5
    assert {r["k"] for r in listed.collect()} == set(values)


def test_log_order_is_time_not_text(spark):
    log = new_scratch(spark, "log")
    one = spark.createDataFrame([("f",)], "relative string")
    for moment in ("2016-09-01 00:00:00", "2016-04-01 00:00:00", "2016-12-01 00:00:00"):
        entry = register.file_statements(one, f"s3a://{moment[5:7]}")
        register.append_log(entry, log, register.FILES, F.lit(moment).cast("timestamp"), "me")
    rows = register.describe_log(register.read_log(spark, log)).collect()
    assert [r["written"] for r in rows] == [
        "01/Apr/2016 00:00:00",
        "01/Sep/2016 00:00:00",
        "01/Dec/2016 00:00:00",
    ]
    assert {r["writer"] for r in rows} == {"me"}


def test_first_level_folders(spark, monthly):
    listing = files.list_files(spark, monthly.location)
    base = listing.first()["path"].removesuffix("/" + listing.first()["relative"])
    found = {r[0].rpartition("/")[2] for r in files.first_level_folders(listing, base).collect()}
    assert found == {"month=1", "month=2", "month=3"}
