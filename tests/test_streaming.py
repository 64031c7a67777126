import pytest
from pyspark.sql import functions as F

from sluice.operators import copy
from sluice.operators.sample import bernoulli_sample
from sluice.session import new_scratch
from sluice.sources.tables import open_folder
from sluice.streaming.incremental import stream_copy


def test_stream_equals_batch_and_reruns_add_nothing(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 5).cast("string").alias("day"))
    landing, target, state = (new_scratch(spark, x) for x in ("landing", "target", "state"))

    def run(files=1):
        stream_copy(spark, landing, frame.schema, ["day"], target, state, 0.2, ["id"], "md5", files)

    def rows():
        return open_folder(spark, "t", target, frame.schema, ("day",)).frame

    copy.write_partitioned(frame.where("day < '2'"), landing, ["day"])
    run()
    first = rows().count()
    run()
    assert rows().count() == first
    copy.write_partitioned(frame.where("day >= '2'"), landing, ["day"], mode="append")
    run()
    expected = bernoulli_sample(frame, 0.2, ["id"])
    assert rows().count() == expected.count() > first
    assert rows().exceptAll(expected).isEmpty()


def test_small_files_are_brought_together(spark):
    frame = spark.range(2000).select("id", F.when(F.col("id") < 1500, "0").otherwise("1").alias("day"))
    landing, target, state = (new_scratch(spark, x) for x in ("landing", "target", "state"))
    copy.write_partitioned(frame.repartition(20), landing, ["day"], cluster=False)
    stream_copy(
        spark, landing, frame.schema, ["day"], target, state, 0.5, ["id"], files_per_partition=2
    )
    files_of = spark.read.schema(frame.schema).parquet(target)
    per_day = files_of.select("day", "_metadata.file_path").distinct().groupBy("day").count()
    assert all(1 <= r["count"] <= 2 for r in per_day.collect())
    assert files_of.count() == bernoulli_sample(frame, 0.5, ["id"]).count()


def test_unrepeatable_sample_is_refused(spark):
    with pytest.raises(ValueError):
        stream_copy(spark, "x", spark.range(1).schema, [], "y", "z", 0.5, method="rand")
