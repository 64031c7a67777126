"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sluice.operators import copy, register, sample, select  # noqa: E402
from sluice.plans import registered  # noqa: E402
from sluice.session import build_session, drop_scratch, new_scratch, pin  # noqa: E402
from sluice.sources import files  # noqa: E402
from sluice.sources.tables import SourceTable, folder_partitions, list_partitions  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "3"))


def force(frame) -> None:
    """Run a query without moving its rows to the driver."""
    frame.write.format("noop").mode("overwrite").save()


class Bench:
    """Tables laid out once, outside the timed part; each case is one timed call."""

    def __init__(self, spark):
        self.spark = spark
        self.lines = registered.table(spark, FOLDER, "lineitem")
        self.events = registered.table(spark, FOLDER, "events")
        self.laid = copy.full_copy(spark, self.lines, new_scratch(spark, "lineitem"))
        self.listed = folder_partitions(spark, self.laid)
        self.done = new_scratch(spark, "done")
        copy.full_copy(spark, self.laid, self.done)
        register.create_database(spark, "bench", new_scratch(spark, "db"))
        register.register_copy(
            spark, "bench.lineitem", self.laid.frame.schema, self.laid.partition_columns, self.laid.location
        )
        self.line_rows = self.lines.frame.count()
        self.line_bytes = files.list_files(spark, self.laid.location).agg(F.sum("length")).first()[0]
        self._like_the_reference()

    def _like_the_reference(self):
        """Inputs of the sizes that the published numbers are of."""
        spark = self.spark
        flags = SourceTable("flags", self.lines.frame, ("l_returnflag",))
        flagged = copy.full_copy(spark, flags, new_scratch(spark, "flags"))
        register.register_copy(
            spark, "bench.flags", flagged.frame.schema, flagged.partition_columns, flagged.location
        )
        orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
        days = orders.select(F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_orderpriority")
        days = days.distinct().orderBy("day", "o_orderpriority").limit(5_639)
        name = F.concat_ws("/", F.concat(F.lit("day="), "day"), F.concat(F.lit("o_orderpriority="), "o_orderpriority"))
        columns = ("day", "o_orderpriority")
        register.register_copy(
            spark, "bench.many", days.select("day", "o_orderpriority").withColumn("x", F.lit(1)).select("x", *columns).schema,
            columns, new_scratch(spark, "many"),
        )
        register.add_partitions(spark, "bench.many", days.withColumn("name", name), columns, new_scratch(spark, "at"))
        self.large = new_scratch(spark, "large")
        spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5).write.parquet(self.large)
        self.large_bytes = files.list_files(spark, self.large).agg(F.sum("length")).first()[0]
        self.thin = new_scratch(spark, "thin")
        copy.incremental_copy(
            spark, self.events, self.thin, list_partitions(self.events), 0.03, registered.KEYS["events"]
        )

    def scratch(self) -> str:
        return new_scratch(self.spark, "bench")

    def count_one_partition(self):
        self.spark.sql(
            "SELECT count(*) FROM bench.lineitem WHERE ship_year = '1997' AND ship_month = '03'"
        ).collect()

    def show_partitions(self):
        force(self.spark.sql("SHOW PARTITIONS bench.lineitem"))

    def count_129k_rows(self):
        self.spark.sql("SELECT count(*) FROM bench.flags WHERE l_returnflag = 'A'").collect()

    def show_5639_partitions(self):
        force(self.spark.sql("SHOW PARTITIONS bench.many"))

    def copy_large_files(self):
        copy.copy_files(self.spark, self.large, self.scratch())

    def incremental_thin_again(self):
        copy.incremental_copy(
            self.spark, self.events, self.thin, list_partitions(self.events), 0.03, registered.KEYS["events"]
        )

    def list_partitions(self):
        force(list_partitions(self.events))

    def folder_sizes(self):
        force(folder_partitions(self.spark, self.laid))

    def last_n_partitions(self):
        force(select.last_n(list_partitions(self.events), 48))

    def multi_spec_partitions(self):
        force(select.last_n_per_spec(list_partitions(self.events), registered.MULTI_SPECS, 5))

    def partition_filter_scan(self):
        force(select.rows_of_specs(self.lines, registered.FILTER_SPECS))

    def sample_md5(self):
        force(sample.bernoulli_sample(self.lines.frame, 0.1, registered.LINE_KEYS, "md5"))

    def sample_xxhash64(self):
        force(sample.bernoulli_sample(self.lines.frame, 0.1, registered.LINE_KEYS, "xxhash64"))

    def sample_rand(self):
        force(sample.bernoulli_sample(self.lines.frame, 0.1, method="rand", seed=1))

    def sample_copy(self):
        copy.sample_copy(self.spark, self.lines, self.scratch(), 0.1, registered.LINE_KEYS)

    def sample_copy_selected(self):
        chosen = pin(select.last_n(self.listed, 24))
        copy.sample_copy(self.spark, self.laid, self.scratch(), 0.1, registered.LINE_KEYS, chosen)

    def full_copy_derived(self):
        copy.full_copy(self.spark, self.lines, self.scratch())

    def full_copy_laid_out(self):
        copy.full_copy(self.spark, self.laid, self.scratch())

    def copy_files(self):
        copy.copy_files(self.spark, self.laid.location, self.scratch())

    def incremental_nothing_new(self):
        copy.incremental_copy(self.spark, self.laid, self.done, self.listed)

    def source_summary(self):
        force(registered._summary(self.spark, FOLDER))

    def copy_log(self):
        force(registered.q_copy_log(self.spark, FOLDER))

    def resume_ledger(self):
        force(registered.q_resume_ledger(self.spark, FOLDER))

    def parent_child_rollup(self):
        force(registered.q_parent_child_rollup(self.spark, FOLDER))

    def tag_lookup(self):
        force(registered.q_tag_lookup(self.spark, FOLDER))

    def expired_copies(self):
        force(registered.q_expired_copies(self.spark, FOLDER))

    def copy_run(self):
        registered._whole_run(self.spark, FOLDER)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    bench = Bench(spark)
    cases = [n for n, v in vars(Bench).items() if callable(v) and not n.startswith("_") and n != "scratch"]
    wanted = set(sys.argv[1:])
    times: dict[str, float] = {}
    spread: dict[str, list[float]] = {}
    for name in cases:
        if wanted and name not in wanted:
            continue
        runs = []
        for _ in range(ROUNDS):
            started = time.perf_counter()
            getattr(bench, name)()
            runs.append(time.perf_counter() - started)
        times[name] = round(statistics.median(runs), 4)
        spread[name] = [round(min(runs), 4), round(max(runs), 4)]
    rates = {
        f"{name}_rows_per_sec": round(bench.line_rows / times[name])
        for name in ("sample_md5", "sample_xxhash64", "sample_rand", "sample_copy", "full_copy_laid_out")
        if name in times
    }
    if "copy_files" in times:
        rates["copy_files_mb_per_sec"] = round(bench.line_bytes / 1e6 / times["copy_files"], 2)
    if "copy_large_files" in times:
        rates["copy_large_files_mb_per_sec"] = round(bench.large_bytes / 1e6 / times["copy_large_files"], 2)
    result = {
        "metric": "total of median times",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "rates": rates,
        "spread": spread,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }
    drop_scratch(spark)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
