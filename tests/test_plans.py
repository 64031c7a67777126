"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from sluice.operators import registry, sample, select
from sluice.plans import checks, registered
from sluice.session import pin
from sluice.sources.files import list_files
from sluice.sources.tables import folder_partitions, list_partitions

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def logical(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


LAZY = [
    "list_partitions", "last_n_partitions", "last_n_top_level", "multi_spec_partitions",
    "multi_spec_partitions_long", "partition_filter_scan", "partition_filter_join", "partition_range_scan",
    "source_totals", "sample_policy", "bernoulli_sample", "bernoulli_sample_band", "size_target_sample",
    "copy_log", "copy_report", "run_totals", "resume_ledger", "path_functions", "first_level_dirs",
    "parent_child_rollup", "parent_child_members", "orphans", "expired_copies", "extend_expiry",
    "tag_lookup", "tag_edit", "common_location", "time_texts",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_global_windows(spark, name):
    text = plan(entry_points.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text
    for window in re.findall(r"Window \[.*?\], \[(.*?)\]", text):
        assert window.strip(), "a window without partition columns"
    assert "Python" not in text


def test_listing_reads_the_time_column_only(spark):
    text = plan(list_partitions(registered.table(spark, FOLDER, "events")))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_last_n_is_a_top_k(spark):
    parts = list_partitions(registered.table(spark, FOLDER, "events"))
    assert "TakeOrderedAndProject(limit=48" in plan(select.last_n(parts, 48))


def test_cap_per_spec_is_limited_before_the_shuffle(spark):
    parts = list_partitions(registered.table(spark, FOLDER, "events"))
    text = plan(select.last_n_per_spec(parts, registered.MULTI_SPECS, 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_time_ranges_reach_the_scan(spark):
    lines = registered.table(spark, FOLDER, "lineitem")
    text = plan(select.rows_of_specs(lines, registered.FILTER_SPECS))
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01T00:00" in text or "PushedFilters: [Or(" in text


def test_ranges_equal_the_text_filter(spark):
    lines = registered.table(spark, FOLDER, "lineitem")
    for specs in (
        registered.FILTER_SPECS,
        [{"ship_year": "1996"}, {"ship_year": "1997"}],
        [{"ship_month": "02"}],
        [{"ship_year": "1996", "ship_month": "12"}, {"ship_year": "nope"}],
    ):
        by_range = select.rows_of_specs(lines, specs)
        by_text = select.matching(lines.frame, specs)
        assert by_range.exceptAll(by_text).isEmpty() and by_text.exceptAll(by_range).isEmpty()


def test_partition_specs_prune_folders(spark, monthly):
    for condition in ([{"month": "2", "day": "1"}], [{"month": "2"}, {"month": "3", "day": "1"}]):
        filters = plan(select.matching(monthly.frame, condition)).split("PartitionFilters: [")[1]
        assert "month" in filters.split("PushedFilters")[0]


def test_long_spec_lists_prune_and_join_by_size(spark, monthly, monkeypatch):
    monkeypatch.setattr(select, "PREDICATE_LIMIT", 1)
    text = plan(select.matching(monthly.frame, [{"month": "2"}, {"month": "3"}]))
    assert "month" in text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "BroadcastHashJoin" in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = select.matching(monthly.frame, [{"month": "2"}, {"month": "3"}])
        assert "Broadcast" not in plan(frame)
        assert frame.count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_broadcast_is_forced(spark, monthly):
    """Every broadcast is Catalyst's choice from a known size."""
    chosen = pin(select.last_n(folder_partitions(spark, monthly), 2))
    rows = select.rows_of(monthly.frame, chosen, ["month", "day"])
    assert "strategy=broadcast" not in logical(rows)
    assert "strategy=broadcast" not in logical(select.matching(monthly.frame, registered.MULTI_SPECS[:0]))


def test_sample_after_partition_filter_still_prunes(spark, monthly):
    rows = select.matching(monthly.frame, [{"month": "2"}])
    for method in ("md5", "rand"):
        text = plan(sample.bernoulli_sample(rows, 0.5, ["name"], method))
        assert "month" in text.split("PartitionFilters: [")[1].split("]")[0]
        assert "Exchange" not in text


def test_listing_reads_lengths_only(spark, monthly):
    text = plan(list_files(spark, monthly.location).agg(F.sum("length")))
    assert "ReadSchema: struct<length:bigint>" in text


def test_children_are_reduced_before_the_join(spark):
    parents = spark.range(10).toDF("id")
    children = spark.range(1000).select(F.lit(1).cast("long").alias("p"), F.col("id").alias("c"))
    text = plan(registry.rollup_children(parents, children, "id", "p", "c"))
    join = text.index("Join")
    assert text.index("partial_sum", join) > join
    row = registry.rollup_children(parents, children, "id", "p", "c").where("parent = 1").first()
    assert row["children"] == row["members"] == 1000


def test_every_query_has_sql():
    assert set(registered.registered()) == set(checks.statements())


def test_a_capped_copy_of_a_flat_table_prunes_its_scan(spark):
    events = registered.table(spark, FOLDER, "events")
    chosen = pin(select.last_n(list_partitions(events), 48))
    text = plan(select.rows_of(events.frame, chosen, ["day", "hour"], events.layout))
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_many_ranges_keep_the_one_around_them(spark):
    events = registered.table(spark, FOLDER, "events")
    specs = [{"day": f"2024-01-{d:02d}", "hour": f"{h:02d}"} for d in range(3, 12) for h in range(0, 24, 2)]
    rows = select.rows_of_specs(events, specs)
    pushed = plan(rows).split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts,2024-01-03" in pushed and "LessThan(ts,2024-01-11" in pushed
    assert rows.exceptAll(select.matching(events.frame, specs)).isEmpty()
    assert rows.count() == select.matching(events.frame, specs).count()
