from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluice.functions import clock, paths, tags
from sluice.sources import formats


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_path_parts(spark):
    full = F.lit("hdfs://node:8020/lake/t/day=1/f")
    row = one(
        spark,
        paths.strip_authority(full),
        paths.parent(full),
        paths.to_location_variable(full),
        paths.from_location_variable(F.lit("at '$LOCATION/lake/t'"), "s3a://b"),
        paths.storage_uri(full, "s3a", "b"),
        paths.path_below(F.lit("/lake/t/day=1/f"), "/lake/t"),
        paths.path_below(F.lit("/lake/t/day=1/f"), "/lake/t", include_base=True),
        paths.first_level_dir(F.lit("/lake/t/day=1/hour=2/f"), "/lake/t"),
    )
    assert list(row) == [
        "/lake/t/day=1/f",
        "hdfs://node:8020/lake/t/day=1",
        "$LOCATION/lake/t/day=1/f",
        "at 's3a://b/lake/t'",
        "s3a://b/lake/t/day=1/f",
        "day=1/f",
        "t/day=1/f",
        "/lake/t/day=1",
    ]


def test_below_needs_a_whole_element(spark):
    assert one(spark, paths.is_below(F.lit("/lake/t2/f"), "/lake/t"))[0] is False
    assert one(spark, paths.is_below(F.lit("/lake/t"), "/lake/t"))[0] is True


AWKWARD = ["a=b/c:d", "tab\there", "\x7f", "\"#'*?\\[]^", "100%", "x y", "a+b", "é", "00", "{q}"]


def test_partition_names_match_the_writer(spark, tmp_path):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*AWKWARD, None])], "i int, k string")
    path = f"file:{tmp_path}/t"
    frame.write.partitionBy("k").parquet(path)
    written = {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()}
    named = {r[0] for r in frame.select(paths.partition_name(["k"])).collect()}
    assert named == written
    back = frame.select(
        "k", paths.partition_pairs(paths.partition_name(["k"])).alias("p"),
        paths.partition_value(F.concat(F.lit("/t/"), paths.partition_name(["k"]), F.lit("/f")), "k").alias("v"),
    )
    for row in back.collect():
        assert row["p"] == [("k", row["k"])]
        assert row["v"] == row["k"]


def test_spec_text_quotes_strings_only(spark):
    pairs = paths.partition_pairs(F.lit("Day=2016-01-01/hour=04"))
    row = one(
        spark,
        paths.spec_text(pairs, {"day": "STRING", "hour": "int"}),
        paths.spec_text(pairs, {"day": "string", "hour": "int"}, " and "),
        paths.column_list(pairs),
    )
    assert list(row) == ["Day='2016-01-01', hour=04", "Day='2016-01-01' and hour=04", "(Day, hour)"]
    with pytest.raises(Exception, match="invalid column: hour"):
        one(spark, paths.spec_text(pairs, {"day": "string"}))


def test_csv_items(spark):
    assert one(spark, paths.csv_items(F.lit("a, b ,c")))[0] == ["a", "b", "c"]


def test_text_lines(spark, tmp_path):
    rows = [(1, "a|b"), (2, ""), (3, None), (4, "back\\slash|"), (5, "two\nlines"), (6, "\\n"), (7, 'say "so"')]
    frame = spark.createDataFrame(rows, "i int, t string")
    for i, sep in enumerate(("|", "\t", ";")):
        kind = formats.delimited(sep, escape='"', multiline=True)
        frame.write.format(kind.source).options(**kind.options).save(f"file:{tmp_path}/{i}")
        back = kind.read(spark, f"file:{tmp_path}/{i}", frame.schema)
        assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_elapsed(spark):
    assert list(one(spark, *[clock.elapsed_text(F.lit(s)) for s in (0, 59, 3600, 90061)])) == [
        "0:00:00",
        "0:00:59",
        "1:00:00",
        "25:01:01",
    ]


def test_time_texts_sort_by_time(spark):
    stamps = ["2016-Sep-01-00-00-00", "2016-Apr-01-00-00-00", "junk"]
    frame = spark.createDataFrame([(s,) for s in stamps], "s string")
    rows = frame.select("s", clock.parse_sortable(F.col("s")).alias("t")).orderBy("t").collect()
    assert [r["s"] for r in rows] == ["junk", "2016-Apr-01-00-00-00", "2016-Sep-01-00-00-00"]
    assert rows[1]["t"] == datetime(2016, 4, 1)
    assert one(spark, clock.readable_text(clock.from_epoch_millis(F.lit(1000).cast("long"))))[0] == (
        "01/Jan/1970 00:00:01"
    )


def test_expiry(spark):
    now = datetime(2020, 1, 10)
    texts = ["01/Jan/2020 00:00:00", "11/Jan/2020 00:00:00", None, "junk", "20/Jan/2020 00:00:00"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select(
        clock.is_expired(F.lit(True), F.col("t"), now).alias("gone"),
        clock.is_expired(F.lit(False), F.col("t"), now).alias("stopped"),
        clock.readable_text(clock.extended_expiry(F.col("t"), now)).alias("more"),
        clock.readable_text(clock.extended_expiry(F.col("t"), now, reset=True)).alias("fresh"),
    ).collect()
    assert {r["fresh"] for r in rows} == {"13/Jan/2020 00:00:00"}
    assert [r["gone"] for r in rows] == [True, False, True, True, False]
    assert not any(r["stopped"] for r in rows)
    assert [r["more"] for r in rows] == [
        "04/Jan/2020 00:00:00",
        "14/Jan/2020 00:00:00",
        "13/Jan/2020 00:00:00",
        None,
        None,
    ]


def test_tags(spark):
    held = F.create_map(F.lit("user.a"), F.lit("1"), F.lit("owner"), F.lit("me"))
    row = one(
        spark,
        tags.tag_equals(held, "owner", "me"),
        tags.tag_equals(held, "missing", "me"),
        tags.tags_with_prefix(held, "user."),
        tags.set_tag(held, "owner", "you"),
        tags.remove_tag(held, "owner"),
    )
    assert list(row) == [True, False, {"a": "1"}, {"user.a": "1", "owner": "you"}, {"user.a": "1"}]
