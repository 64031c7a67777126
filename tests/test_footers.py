import uuid
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sluice.model import CopyPolicy, TableSpec
from sluice.plans.run import RunTarget, copy_tables
from sluice.session import new_scratch
from sluice.sources import footers
from sluice.sources.layouts import EVENT_DAY
from sluice.sources.tables import SourceTable, list_partitions


def flat(spark, tmp_path, hours, rows_per_group, files=1):
    """A flat table with a row per listed hour, in row groups of some rows."""
    start = datetime(2024, 1, 1)
    folder = tmp_path / f"a+b {uuid.uuid4().hex}"
    folder.mkdir()
    each = -(-len(hours) // files)
    for n in range(files):
        part = [None if h is None else start + timedelta(hours=h) for h in hours[n * each : (n + 1) * each]]
        data = pa.table({"ts": pa.array(part, pa.timestamp("us")), "v": pa.array([f"v{x}" for x in range(len(part))])})
        pq.write_table(data, folder / f"part {n}.parquet", row_group_size=rows_per_group)
    frame = spark.read.parquet(f"file:{folder}")
    return SourceTable("lake.events", EVENT_DAY.apply(frame), ("day",), layout=EVENT_DAY), folder


def rows_of(sizes):
    return {r["day"]: r["row_count"] for r in sizes.collect()}


def total(folder):
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in folder.iterdir() if f.suffix == ".parquet" for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    return sum(g.column(i).total_compressed_size for g in groups for i in range(g.num_columns))


@pytest.mark.parametrize("hours", [list(range(240)), [h * 37 % 240 for h in range(240)], [None, 5, 30, None] * 20])
@pytest.mark.parametrize("files", [1, 3])
def test_rows_and_bytes_add_up(spark, tmp_path, hours, files):
    table, folder = flat(spark, tmp_path, hours, 24, files)
    sizes = footers.partition_sizes(spark, table)
    assert rows_of(sizes) == rows_of(list_partitions(table))
    assert sum(r["bytes"] for r in sizes.collect()) == total(folder)
    whole = footers.table_size(spark, table).first()
    assert (whole["files"], whole["rows"], whole["bytes"]) == (files, len(hours), total(folder))


def test_sorted_groups_are_not_scanned(spark, tmp_path, monkeypatch):
    table, _ = flat(spark, tmp_path, list(range(240)), 24)
    monkeypatch.setattr(footers, "_dealt", lambda *args: pytest.fail("the time column was scanned"))
    assert rows_of(footers.partition_sizes(spark, table)) == {f"2024-01-{d:02d}": 24 for d in range(1, 11)}


def test_only_files_with_mixed_groups_are_joined(spark, tmp_path, monkeypatch):
    table, _ = flat(spark, tmp_path, [*range(48), *(h * 7 % 48 for h in range(48))], 24, files=2)
    seen = []
    dealt = footers._dealt
    monkeypatch.setattr(footers, "_dealt", lambda t, mixed: seen.extend(r["path"] for r in mixed.collect()) or dealt(t, mixed))
    assert rows_of(footers.partition_sizes(spark, table)) == {"2024-01-01": 48, "2024-01-02": 48}
    assert {p.rpartition("/")[2] for p in seen} == {"part 1.parquet"}


def test_a_run_sized_by_footers(spark, tmp_path):
    table, folder = flat(spark, tmp_path, list(range(240)), 24)
    target = RunTarget(new_scratch(spark, "run"), f"db_{uuid.uuid4().hex}")
    spec = TableSpec("lake.events", partition_count=4, sample_prob=0.5)
    for threshold, mode in ((total(folder), "full"), (total(folder) // 4, "sample")):
        policy = CopyPolicy(footer_sizes=True, sample_threshold=threshold)
        result = copy_tables(spark, {"lake.events": table}, [spec], target, policy)
        assert result.errors == {} and result.modes == {"lake.events": mode}
        days = {r["day"] for r in spark.table(target.table_of("lake.events")).select("day").distinct().collect()}
        assert days <= {f"2024-01-{d:02d}" for d in range(7, 11)}
    spark.sql(f"DROP DATABASE {target.database} CASCADE")
