import os

import pytest
from conftest import lay_out, names
from pyspark.sql import functions as F

from sluice import storage
from sluice.operators import copy, hooks, select
from sluice.session import new_scratch, pin
from sluice.sources import files
from sluice.sources.formats import ORC
from sluice.sources.tables import SourceTable, folder_partitions, list_partitions, open_folder


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def local(path):
    return path.removeprefix("file:")


def test_full_copy_equals_source(spark, monthly):
    done = copy.full_copy(spark, monthly, new_scratch(spark, "t"))
    assert same(done.frame, monthly.frame)
    assert names(folder_partitions(spark, done)) == names(folder_partitions(spark, monthly))


def test_copy_keeps_the_storage_format(spark, monthly):
    path = new_scratch(spark, "orc")
    copy.write_partitioned(monthly.frame, path, ["month", "day"], storage=ORC)
    source = open_folder(spark, "t", path, monthly.frame.schema, ("month", "day"), ORC)
    done = copy.sample_copy(spark, source, new_scratch(spark, "t"), 0.999999, ("name",))
    assert done.storage == ORC
    assert files.list_files(spark, done.location, "*.orc").count() > 0
    assert same(done.frame, monthly.frame)


def test_sample_is_a_subset_and_empty_partitions_vanish(spark):
    source = lay_out(spark, [(f"n{i}", i % 12 + 1, i % 28 + 1) for i in range(400)])
    done = copy.sample_copy(spark, source, new_scratch(spark, "t"), 0.05, ("name",))
    assert 0 < done.frame.count() < 400
    assert done.frame.exceptAll(source.frame).isEmpty()
    assert set(names(folder_partitions(spark, done))) == set(names(list_partitions(done)))
    assert len(names(folder_partitions(spark, done))) < len(names(folder_partitions(spark, source)))


def test_plain_table_sample(spark):
    frame = spark.range(100).withColumn("name", F.lit("x"))
    done = copy.sample_copy(spark, SourceTable("t", frame), new_scratch(spark, "t"), 0.9999999999999999, ("id",))
    assert 0 < done.frame.count() <= 100
    assert copy.full_copy(spark, SourceTable("t", frame), new_scratch(spark, "t")).frame.count() == 100


def test_incremental_copy_brings_only_what_is_new(spark, monthly):
    path = new_scratch(spark, "t")
    listed = folder_partitions(spark, monthly)
    early = pin(listed.where("month < 3"))
    copy.full_copy(spark, monthly, path, early)
    before = {r["path"] for r in files.list_files(spark, path).collect()}
    arrived = copy.incremental_copy(spark, monthly, path, listed)
    assert names(arrived) == ["month=3/day=1", "month=3/day=2"]
    after = {r["path"] for r in files.list_files(spark, path).collect()}
    assert before < after
    done = open_folder(spark, "t", path, monthly.frame.schema, ("month", "day"))
    assert same(done.frame, monthly.frame)
    assert copy.incremental_copy(spark, monthly, path, listed).isEmpty()
    assert {r["path"] for r in files.list_files(spark, path).collect()} == after


def test_incremental_copy_on_an_object_store(spark, monthly, monkeypatch):
    path = new_scratch(spark, "t")
    listed = folder_partitions(spark, monthly)
    copy.full_copy(spark, monthly, path, pin(listed.where("month < 3")))
    monkeypatch.setattr(storage, "renames_in_place", lambda spark, path: False)
    assert len(names(copy.incremental_copy(spark, monthly, path, listed))) == 2
    done = open_folder(spark, "t", path, monthly.frame.schema, ("month", "day"))
    assert same(done.frame, monthly.frame)


def test_incremental_copy_with_null_partition(spark):
    source = lay_out(spark, [("a", None, 1), ("b", 1, None), ("c", 1, 1)])
    path = new_scratch(spark, "t")
    listed = folder_partitions(spark, source)
    assert len(names(copy.incremental_copy(spark, source, path, listed))) == 3
    assert copy.incremental_copy(spark, source, path, listed).isEmpty()
    done = open_folder(spark, "t", path, source.frame.schema, ("month", "day"))
    assert same(done.frame, source.frame)


def test_hot_partition_is_written_by_many_tasks(spark):
    """One partition with most rows is split; the copy is still whole."""
    frame = spark.range(200_000).select(
        F.md5(F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 5).cast("int").alias("month"),
    )
    keys = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "512k",
    }
    before = {k: spark.conf.get(k) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        path = new_scratch(spark, "hot")
        copy.write_partitioned(frame, path, ["month"])
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    counts = {r["name"]: r["files"] for r in files.partition_folders(files.list_files(spark, path)).collect()}
    assert counts["month=1"] > 1
    assert counts["month=4"] == 1
    assert spark.read.parquet(path).count() == 200_000


def test_hot_partition_without_adaptive_execution(spark):
    frame = spark.range(5_000).select("id", F.lit("hot").alias("day"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = new_scratch(spark, "hot")
        copy.write_partitioned(frame, path, ["day"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert files.list_files(spark, path).count() > 1
    assert spark.read.parquet(path).select("id").distinct().count() == 5_000


def test_publish_is_all_or_nothing(spark, monthly):
    root = new_scratch(spark, "publish")
    target = f"{root}/t"

    def fail(path):
        monthly.frame.write.parquet(path)
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        copy.staged_publish(spark, fail, target)
    assert storage.child_names(spark, root) == []
    copy.staged_publish(spark, monthly.frame.write.parquet, target)
    assert storage.child_names(spark, root) == ["t"]
    with pytest.raises(FileExistsError):
        copy.staged_publish(spark, monthly.frame.write.parquet, target)
    copy.staged_publish(spark, monthly.frame.limit(1).write.parquet, target, overwrite=True)
    assert spark.read.parquet(target).count() == 1


def test_staging_guard(spark, monthly):
    with pytest.raises(ValueError, match="not a staging folder"):
        copy.drop_staging(spark, monthly.location)
    assert storage.exists(spark, monthly.location)


def test_byte_copy(spark, tmp_path):
    source, target = tmp_path / "src", tmp_path / "dst"
    (source / "day=1" / "x").mkdir(parents=True)
    (source / "day=1" / "x" / "big").write_bytes(os.urandom(20 << 20))
    (source / "day=1" / "small one").write_bytes(b"abc")
    (source / "day=1" / "empty").write_bytes(b"")
    (source / "day=1" / "_SUCCESS").write_bytes(b"")
    (source / "top").write_bytes(b"12345")
    report = copy.copy_files(spark, f"file:{source}", f"file:{target}")
    assert report.count() == 5
    assert copy.incomplete(report).isEmpty()
    for path in source.rglob("*"):
        if path.is_file():
            assert (target / path.relative_to(source)).read_bytes() == path.read_bytes()
    assert not [p for p in target.rglob(".*") if not p.name.endswith(".crc")]


@pytest.mark.parametrize("budget", [1, 5, 10_000])
def test_walk_finds_all_files(spark, tmp_path, budget):
    expected = set()
    for i in range(30):
        folder = tmp_path / f"a{i % 3}" / f"b{i % 7}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}").write_text("x" * i)
        expected.add((f"a{i % 3}/b{i % 7}/f{i}", i))
    (tmp_path / "hollow" / "deep").mkdir(parents=True)
    start = spark.createDataFrame([(f"file:{tmp_path}", "")], "path string, relative string")
    found = files.walk_folders(start, budget=budget)
    assert sorted((r["relative"], r["length"]) for r in found.collect()) == sorted(expected)
    assert files.walk_folders(start.limit(0)).isEmpty()
    assert files.walk_files(spark, f"file:{tmp_path}", "f1*").count() == 11


def test_full_copy_of_bytes_keeps_the_layout(spark, monthly):
    chosen = pin(select.last_n(folder_partitions(spark, monthly), 3))
    done = copy.full_copy_bytes(spark, monthly, new_scratch(spark, "t"), chosen)
    assert done.frame.count() == 6
    assert names(folder_partitions(spark, done)) == names(chosen)
    before = {r["relative"] for r in files.list_files(spark, monthly.location).collect()}
    assert {r["relative"] for r in files.list_files(spark, done.location).collect()} < before
    whole = copy.full_copy_bytes(spark, monthly, new_scratch(spark, "t"))
    assert same(whole.frame, monthly.frame)
    with pytest.raises(ValueError, match="no files of its own"):
        copy.full_copy_bytes(spark, SourceTable("t", monthly.frame), new_scratch(spark, "t"))


def test_byte_copy_without_overwrite(spark, tmp_path):
    source, target = tmp_path / "src", tmp_path / "dst"
    source.mkdir()
    target.mkdir()
    (source / "a").write_bytes(b"new")
    (source / "b").write_bytes(b"new")
    (target / "a").write_bytes(b"old")
    report = copy.copy_files(spark, f"file:{source}", f"file:{target}", overwrite=False)
    assert [r["target"].rpartition("/")[2] for r in report.collect()] == ["b"]
    assert (target / "a").read_bytes() == b"old"
    copy.copy_files(spark, f"file:{source}", f"file:{target}")
    assert (target / "a").read_bytes() == b"new"


def test_replaced_file_reads_back(spark, tmp_path):
    """A checksum left by the file that was there before does not spoil the new one."""
    for name, text in (("src", "new"), ("dst", "old")):
        spark.createDataFrame([(text,)], "t string").coalesce(1).write.text(f"file:{tmp_path}/{name}")
    (old,) = (tmp_path / "dst").glob("part-*")
    (new,) = (tmp_path / "src").glob("part-*")
    report = copy.copy_files(spark, f"file:{new}", f"file:{tmp_path}/one")
    assert [r["copied"] for r in report.collect()] == [4]
    new.rename(new.with_name(old.name))
    copy.copy_files(spark, f"file:{tmp_path}/src", f"file:{tmp_path}/dst")
    assert [r[0] for r in spark.read.text(f"file:{tmp_path}/dst").collect()] == ["new"]


def test_two_hops_leave_nothing_behind(spark, monthly):
    via, target = new_scratch(spark, "via"), new_scratch(spark, "t")
    report = copy.copy_through(spark, monthly.location, via, target)
    assert copy.incomplete(report).isEmpty()
    assert storage.child_names(spark, via) == []
    done = open_folder(spark, "t", target, monthly.frame.schema, ("month", "day"))
    assert same(done.frame, monthly.frame)


def test_files_outside_the_base_are_an_error(spark):
    listing = spark.createDataFrame([("/lake/t/a",), ("/lake/u/b",)], "path string")
    with pytest.raises(Exception, match="not below /lake/t: /lake/u/b"):
        copy.common_location(listing, "/lake/t").collect()


def test_hooks(spark, monthly, tmp_path):
    with open(f"{local(storage.qualify(spark, monthly.location))}/table.meta", "w") as out:
        out.write("x")
    seen = []

    def mark(rows):
        seen.append(rows.columns)
        return rows.withColumn("name", F.upper("name"))

    done = copy.sample_copy(
        spark, monthly, new_scratch(spark, "t"), 0.99999, ("name",), before_sample=[mark]
    )
    hooks.copy_side_files("*.meta")(hooks.CopyContext(spark, monthly, done, "sample"))
    assert seen == [["name", "month", "day"]]
    assert {r["name"] for r in done.frame.collect()} <= {"A", "B"}
    assert files.list_files(spark, done.location, "*.meta").count() == 1


def test_rows_of_prunes_folders(spark, monthly):
    chosen = pin(select.last_n(folder_partitions(spark, monthly), 1))
    rows = select.rows_of(monthly.frame, chosen, ["month", "day"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    located = monthly.frame.select("*", "_metadata.file_path")
    located = select.rows_of(located, chosen, ["month", "day"]).select("file_path").distinct()
    read = {r[0].rpartition("/")[0] for r in located.collect()}
    assert len(read) == 1 and read.pop().endswith("month=3/day=2")


def test_a_failed_publish_keeps_the_old_copy(spark, monthly, monkeypatch):
    target = f"{new_scratch(spark, 'publish')}/t"
    copy.staged_publish(spark, lambda path: copy.full_copy(spark, monthly, path), target)
    rename = storage.rename

    def refuse(spark, source, to):
        if to == target and copy.STAGING_HINT in source and not refused:
            refused.append(source)
            raise OSError("no")
        rename(spark, source, to)

    refused = []
    monkeypatch.setattr(copy.folders, "rename", refuse)
    with pytest.raises(OSError):
        copy.staged_publish(spark, lambda path: copy.full_copy(spark, monthly, path), target, overwrite=True)
    assert spark.read.parquet(target).count() == 12
    assert storage.child_names(spark, target.rpartition("/")[0]) == ["t"]


def test_empty_samples_are_taken_in_once(spark, monthly):
    path = new_scratch(spark, "t")
    listed = pin(list_partitions(monthly))
    first = copy.incremental_copy(spark, monthly, path, listed, 0.001, ["name"])
    assert first.count() == 6
    assert copy.recorded_partitions(spark, path).count() == 6
    assert copy.incremental_copy(spark, monthly, path, listed, 0.001, ["name"]).isEmpty()
