import os
import uuid

import pytest
from conftest import names

from sluice import storage
from sluice.operators import copy, register, sweep
from sluice.session import new_scratch
from sluice.sources.tables import list_partitions, open_folder


@pytest.fixture
def place(spark, monthly):
    """A folder with a copy, and a database of its own."""
    root, database = new_scratch(spark, "sweep"), f"sweep_{uuid.uuid4().hex}"
    register.create_database(spark, database, new_scratch(spark, "database"))
    return root, database, copy.full_copy(spark, monthly, f"{root}/copy")


def found(spark, place, age=0, **options):
    return sweep.leftovers(spark, [place[0]], age, [place[1]], **options)


def kinds(frame):
    return sorted(r["kind"] for r in frame.collect())


def rows_of(spark, done):
    again = open_folder(spark, "copy", done.location, done.frame.schema, done.partition_columns)
    return {r["name"]: r["row_count"] for r in list_partitions(again).collect()}


def test_a_clean_folder_has_none(spark, place):
    assert found(spark, place).count() == 0
    assert sweep.leftovers(spark, [f"{place[0]}/not-there"], 0, [place[1]]).count() == 0


def test_half_written_copies_go(spark, place, monthly):
    root, _, done = place
    before = rows_of(spark, done)
    copy.write_partitioned(monthly.frame, copy.staging_path(f"{root}/copy"), ["month"])
    copy.write_partitioned(monthly.frame, copy.staging_path(f"{root}/deep/er/copy"), [])
    storage.write_text(spark, f"{root}/copy/month=1/.x.parquet.{uuid.uuid4().hex}", "half")
    left = found(spark, place)
    assert kinds(left) == ["part", "staging", "staging"]
    assert all(r["files"] > 0 and r["bytes"] > 0 and r["age"] >= 0 for r in left.collect())
    assert sweep.sweep(spark, left) == {"restored": 0, "removed": 3}
    assert found(spark, place).count() == 0 and rows_of(spark, done) == before


def test_young_ones_stay(spark, place, monthly):
    """One young file tells that a run may still be at work there."""
    staging = copy.staging_path(f"{place[0]}/copy")
    copy.write_partitioned(monthly.frame.coalesce(1), staging, ["month"])
    assert found(spark, place, 3600).count() == 0
    old = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(staging).select("path").collect()]
    for path in old[1:]:
        storage.set_age(spark, path, 7_200_000)
    marker = f"{staging}/_SUCCESS"
    storage.set_age(spark, marker, 7_200_000)
    assert found(spark, place, 3600).count() == 0
    storage.set_age(spark, old[0], 7_200_000)
    assert kinds(found(spark, place, 3600)) == ["staging"]


def test_what_the_catalog_refers_to_stays(spark, place, monthly):
    root, database, _ = place
    staging = copy.staging_path(f"{root}/copy")
    kept = copy.full_copy(spark, monthly, f"{staging}/inside")
    register.register_copy(spark, f"{database}.t", kept.frame.schema, kept.partition_columns, kept.location)
    assert found(spark, place).count() == 0
    spark.sql(f"DROP TABLE {database}.t")
    assert kinds(found(spark, place)) == ["staging"]


def test_a_partition_elsewhere_is_referred_to(spark, place, monthly):
    root, database, done = place
    register.register_copy(spark, f"{database}.t", done.frame.schema, done.partition_columns, done.location)
    staging = copy.staging_path(f"{root}/other")
    copy.full_copy(spark, monthly, staging)
    spark.sql(f"ALTER TABLE {database}.t ADD PARTITION (month=9, day=9) LOCATION '{staging}/month=1/day=1'")
    assert found(spark, place).count() == 0


def test_a_copy_moved_aside_comes_back(spark, place):
    """The old copy was moved aside and the new one never came."""
    root, _, done = place
    before = rows_of(spark, done)
    storage.rename(spark, f"{root}/copy", copy.staging_path(f"{root}/copy", copy.ASIDE))
    assert sweep.sweep(spark, found(spark, place)) == {"restored": 1, "removed": 0}
    assert rows_of(spark, done) == before and found(spark, place).count() == 0


def test_an_old_copy_with_a_successor_goes(spark, place, monthly):
    root, _, done = place
    copy.full_copy(spark, monthly, copy.staging_path(f"{root}/copy", copy.ASIDE))
    before = rows_of(spark, done)
    assert sweep.sweep(spark, found(spark, place)) == {"restored": 0, "removed": 1}
    assert rows_of(spark, done) == before


def test_partitions_moved_aside_come_back(spark, place, monthly):
    """One of them has its new contents already and keeps them."""
    root, _, done = place
    before = rows_of(spark, done)
    aside = copy.staging_path(f"{root}/copy", copy.SWAPPED)
    storage.rename(spark, f"{root}/copy/month=1/day=2", f"{aside}/month=1/day=2")
    storage.rename(spark, f"{root}/copy/month=3", f"{aside}/month=3")
    monthly.frame.where("month = 1").limit(1).drop("month", "day").write.parquet(f"{root}/copy/month=3/day=1")
    assert sweep.sweep(spark, found(spark, place))["restored"] == 2
    assert rows_of(spark, done) == {**before, "month=3/day=1": 1}
    assert found(spark, place).count() == 0


def test_a_failed_swap_is_mended(spark, place, monkeypatch):
    """A run that dies between the moves of ``replace_partitions``, without its own clean-up."""
    root, _, done = place
    before = rows_of(spark, done)
    monkeypatch.setattr(copy, "drop_staging", lambda spark, path: None)
    rename = storage.rename

    def dies(spark, source, target):
        if copy.STAGING_HINT in source:
            raise KeyboardInterrupt
        rename(spark, source, target)

    monkeypatch.setattr(copy.folders, "rename", dies)
    chosen = spark.createDataFrame([("month=2/day=1",)], "name string")
    fresh = done.frame.where("month = 2 AND day = 1")
    with pytest.raises(KeyboardInterrupt):
        copy.replace_partitions(spark, f"{root}/copy", chosen, lambda _, path: copy.write_partitioned(fresh, path, ["month", "day"]))
    monkeypatch.setattr(copy.folders, "rename", rename)
    assert "month=2/day=1" not in rows_of(spark, done)
    assert kinds(found(spark, place)) == ["staging", "swapped"]
    assert sweep.sweep(spark, found(spark, place)) == {"restored": 1, "removed": 2}
    assert rows_of(spark, done) == before


def test_scratch_of_other_processes(spark, place, monthly):
    root = place[0]
    other = f"{root}/sluice-pin-{uuid.uuid4().hex}"
    monthly.frame.write.parquet(other)
    mine = new_scratch(spark, "mine")
    monthly.frame.write.parquet(f"{root}/{mine.rpartition('/')[2]}")
    assert found(spark, place).count() == 0
    left = found(spark, place, scratch=True)
    assert [os.path.basename(r["path"]) for r in left.collect()] == [os.path.basename(other)]
    assert sweep.sweep(spark, left)["removed"] == 1 and not storage.exists(spark, other)


def test_names_like_leftovers(spark, place, monthly):
    """Only names that the library gives count."""
    root = place[0]
    for name in ("a__staging_b", "a__staging_0123456789ab0", "sluice-x", ".hidden"):
        monthly.frame.write.parquet(f"{root}/{name}")
    assert found(spark, place, scratch=True).count() == 0
    assert names(list_partitions(place[2])) == names(list_partitions(monthly))
