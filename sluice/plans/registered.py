"""Registered queries: every operator, run over the whole given tables.

Each takes ``(spark, folder)`` and returns a frame. Queries that write do so in a fresh
folder below the shared scratch root and return what a reader of the copy sees.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import storage
from sluice.functions import clock, paths, tags
from sluice.model import LEDGER_SCHEMA, SUMMARY_SCHEMA, CopyPolicy, TableSpec, UnresolvedRequest
from sluice.operators import cleanup as cleaning
from sluice.operators import bucketed, copy, hooks, ledger, register, registry, sample, select, sweep, transfer
from sluice.plans import run as runs
from sluice.session import local_rows, new_scratch, pin
from sluice.sources import files, footers, formats
from sluice.sources.layouts import EVENT_DAY, EVENT_HOUR, ORDER_MONTH, SHIP_MONTH
from sluice.sources.tables import (
    SourceTable,
    catalog_partitions,
    column_definitions,
    export_summary,
    folder_partitions,
    list_partitions,
    located_partitions,
    open_catalog,
    open_flat,
    open_folder,
    source_summary,
    summary_totals,
)
from sluice.streaming.incremental import stream_copy
from sluice.streaming.registered import stream_into_copy

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

LAYOUTS = {"lineitem": SHIP_MONTH, "events": EVENT_HOUR, "orders": ORDER_MONTH}

LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEYS = {"lineitem": LINE_KEYS, "orders": ("o_orderkey",), "events": ("event_id",)}

TEXT = formats.StorageFormat("text")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> SourceTable:
    return open_flat(spark, folder, name, LAYOUTS.get(name))


def _database(spark: SparkSession) -> str:
    name = f"sluice_{uuid.uuid4().hex}"
    register.create_database(spark, name, new_scratch(spark, "database"))
    return name


def _laid_out(spark: SparkSession, source: SourceTable) -> SourceTable:
    return copy.full_copy(spark, source, new_scratch(spark, source.name))


# --- partitions -------------------------------------------------------------------------


def q_list_partitions(spark, folder):
    return list_partitions(table(spark, folder, "events")).select("name", "row_count")


def q_catalog_partitions(spark, folder):
    """Registered partitions below a partial spec, each with a folder that holds bytes."""
    laid = _laid_out(spark, table(spark, folder, "lineitem"))
    name = f"{_database(spark)}.lineitem"
    register.register_copy(spark, name, laid.frame.schema, laid.partition_columns, laid.location)
    listed = catalog_partitions(spark, name, {"ship_year": "1997"})
    present = folder_partitions(spark, laid).select("name", (F.col("bytes") > 0).alias("has_bytes"))
    return listed.join(present, "name").select("ship_year", "ship_month", "name", "has_bytes")


def q_last_n_partitions(spark, folder):
    return select.last_n(list_partitions(table(spark, folder, "events")), 48).select("name", "row_count")


def q_last_n_top_level(spark, folder):
    listed = list_partitions(table(spark, folder, "events"))
    return select.last_n_top_level(listed, 7).select("name", "row_count")


MULTI_SPECS = [
    {"day": "2024-01-05"},
    {"day": "2024-01-28"},
    {"hour": "13"},
    {"day": "2024-01-05", "hour": "07"},
]


def q_multi_spec_partitions(spark, folder):
    listed = list_partitions(table(spark, folder, "events"))
    return select.last_n_per_spec(listed, MULTI_SPECS, 5).select("name", "row_count")


def long_specs() -> list[dict[str, str]]:
    """More specs than one predicate takes: all hours before noon, plus two whole days."""
    hours = [{"day": f"2024-01-{d:02d}", "hour": f"{h:02d}"} for d in range(1, 31) for h in range(12)]
    return hours + [{"day": "2024-01-09"}, {"day": "2024-01-10"}]


def q_multi_spec_partitions_long(spark, folder):
    listed = list_partitions(table(spark, folder, "events"))
    return select.last_n_per_spec(listed, long_specs(), 10).select("name", "row_count")


REQUEST_TEXTS = [
    "lake.events (day='2024-01-05') (day='2024-01-06', hour='10')",
    "lake.orders (order_month='1995-03')",
    "lake.orders (order_month='1890-01')",
    "lake.lineitem (ship_year='1996', ship_month='02')",
    "lake.returns (day='2024-01-05')",
    "nonsense",
]


def q_resolve_requests(spark, folder):
    """Request texts to partitions; a request that cannot be resolved becomes an error row."""
    schema = "request string, name string, error string"
    result = local_rows(spark, [], schema)
    parsed = select.specs_from_text(spark, REQUEST_TEXTS)
    for text, (name, specs) in zip(REQUEST_TEXTS, parsed):
        try:
            if name is None:
                raise UnresolvedRequest("cannot read request")
            source = table(spark, folder, name.rpartition(".")[2])
            listed = list_partitions(source)
            chosen = select.resolve(listed, specs)
            rows = chosen.select(
                F.lit(text).alias("request"), "name", F.lit(None).cast("string").alias("error")
            )
        except UnresolvedRequest as error:
            rows = local_rows(spark, [(text, None, str(error))], schema)
        result = result.unionByName(rows)
    return result


FILTER_SPECS = [
    {"ship_year": "1996", "ship_month": "03"},
    {"ship_year": "1997"},
    {"ship_year": "1998", "ship_month": "11"},
]
LINE_OUT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "ship_year", "ship_month"]


def q_partition_filter_scan(spark, folder):
    return select.rows_of_specs(table(spark, folder, "lineitem"), FILTER_SPECS).select(*LINE_OUT)


def q_partition_filter_join(spark, folder):
    return select.matching(table(spark, folder, "events").frame, long_specs()).select(
        "event_id", "day", "hour"
    )


def q_partition_range_scan(spark, folder):
    """The same specs as ranges on the time column, pushed into the scan."""
    return select.rows_of_specs(table(spark, folder, "events"), long_specs()).select(
        "event_id", "day", "hour"
    )


def q_partition_filter_folders(spark, folder):
    """Specs against a laid-out copy, where they prune folders."""
    laid = _laid_out(spark, table(spark, folder, "lineitem"))
    return select.rows_of_specs(laid, FILTER_SPECS).select(*LINE_OUT)


def q_partition_semi_join(spark, folder):
    """Rows of the last 24 partitions of a laid-out copy, by a pruned semi join."""
    laid = _laid_out(spark, table(spark, folder, "lineitem"))
    chosen = pin(select.last_n(folder_partitions(spark, laid), 24))
    return select.rows_of(laid.frame, chosen, laid.partition_columns).select(*LINE_OUT)


# --- sizes ------------------------------------------------------------------------------


def _summary(spark, folder) -> DataFrame:
    sources, errors = {}, {}
    for name in [*TABLES, "returns"]:
        try:
            sources[name] = table(spark, folder, name)
        except UnresolvedRequest as error:
            errors[name] = str(error)
    return source_summary(spark, sources, errors)


def q_source_summary(spark, folder):
    """All tables and one that does not exist, exported as CSV and read back."""
    path = new_scratch(spark, "summary")
    export_summary(_summary(spark, folder), path)
    return spark.read.schema(SUMMARY_SCHEMA).option("header", True).csv(path)


def q_footer_sizes(spark, folder):
    """Rows by month from file footers; the bytes of the months are those of the whole table."""
    lines = table(spark, folder, "lineitem")
    sizes = footers.partition_sizes(spark, lines)
    total = footers.table_size(spark, lines).select(F.col("rows").alias("all_rows"), F.col("bytes").alias("all_bytes"))
    sums = sizes.agg(F.sum("bytes").alias("summed"))
    counted = _with_scalar(_with_scalar(sizes, total), sums)
    return counted.select("name", "row_count", "all_rows", (F.col("summed") == F.col("all_bytes")).alias("adds_up"))


def q_source_totals(spark, folder):
    return summary_totals(_summary(spark, folder))


def _text_copy(spark, folder) -> SourceTable:
    """lineitem as one text line per row, so that file sizes follow from the rows."""
    source = table(spark, folder, "lineitem")
    columns = list(source.partition_columns)
    line = F.concat_ws("|", *LINE_KEYS, "l_returnflag", "l_linestatus").alias("line")
    path = new_scratch(spark, "text")
    copy.write_partitioned(source.frame.select(line, *columns), path, columns, storage=TEXT)
    schema = T.StructType().add("value", "string")
    for name in columns:
        schema = schema.add(name, "string")
    return open_folder(spark, "lineitem", path, schema, tuple(columns), TEXT)


def q_partition_bytes(spark, folder):
    """Location and bytes per partition from the file listing; no file is opened."""
    laid = _text_copy(spark, folder)
    place = F.lit(laid.location.rpartition("/")[2])
    return folder_partitions(spark, laid).select(
        "name",
        "bytes",
        F.endswith("location", F.concat(place, F.lit("/"), F.col("name"))).alias("below_table"),
    )


def q_source_summary_folders(spark, folder):
    """The summary of a laid-out table: sizes and partitions from the listing alone."""
    return source_summary(spark, {"lineitem": _text_copy(spark, folder)}, {})


# --- policy and samples -----------------------------------------------------------------

POLICY = CopyPolicy(default_prob=0.01, default_partition_count=-1, sample_threshold=20_000)
POLICY_SPECS = [
    TableSpec("lineitem", sample_prob=0.02),
    TableSpec("orders", sample_prob=0.5, sample_size=25_000, skip_cleanup=True),
    TableSpec("events", partition_count=3),
    TableSpec("documents", sample_prob=1.0),
    TableSpec("customer", sample_size=10_000_000_000),
    TableSpec("region", sample_prob=0.5),
    TableSpec("returns", sample_prob=0.5),
]


def _policy(spark, folder, policy) -> DataFrame:
    requests = sample.requests_frame(spark, POLICY_SPECS)
    return sample.resolve_policy(_summary(spark, folder), requests, policy)


def q_sample_policy(spark, folder):
    return _policy(spark, folder, POLICY)


def q_sample_policy_size_default(spark, folder):
    return _policy(spark, folder, CopyPolicy(default_size=30_000, sample_threshold=0))


def q_bernoulli_sample(spark, folder):
    lines = table(spark, folder, "lineitem").frame
    return sample.bernoulli_sample(lines, 0.1, LINE_KEYS).select(*LINE_KEYS, "l_quantity")


def q_bernoulli_sample_rand(spark, folder):
    """A ``rand`` sample holds rows of the table only, none more often than the table, and
    its share of every ship year."""
    lines = table(spark, folder, "lineitem").frame
    kept = pin(sample.bernoulli_sample(lines, 0.1, method="rand", seed=7), "rand")
    every = [c for c in lines.columns]
    there = lines.groupBy(*every).agg(F.count("*").alias("n"))
    drawn = kept.groupBy(*every).agg(F.count("*").alias("k"))
    on = [there[c].eqNullSafe(drawn[c]) for c in every]
    both = there.join(drawn, on, "full_outer").select(
        F.coalesce(there["ship_year"], drawn["ship_year"]).alias("ship_year"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("k", F.lit(0)).alias("k"),
    )
    years = both.groupBy("ship_year").agg(
        F.sum("n").alias("row_count"),
        F.sum("k").alias("kept"),
        F.count_if(F.col("k") > F.col("n")).alias("too_many"),
    )
    return years.select(
        "ship_year",
        "row_count",
        "too_many",
        sample.in_sigma_band(F.col("row_count"), F.col("kept"), 0.1).alias("in_band"),
    )


def q_bernoulli_sample_band(spark, folder):
    """Every method keeps a share within five standard deviations, per ship year."""
    methods = ("md5", "xxhash64", "rand")
    lines = table(spark, folder, "lineitem").frame
    marked = lines.select("ship_year", *[sample.sampled(0.1, LINE_KEYS, m, 7).alias(m) for m in methods])
    counts = marked.groupBy("ship_year").agg(
        F.count("*").alias("row_count"), *[F.count_if(F.col(m)).alias(m) for m in methods]
    )
    bands = [
        sample.in_sigma_band(F.col("row_count"), F.col(m), 0.1).alias(f"{m}_in_band")
        for m in methods
    ]
    return counts.select("ship_year", "row_count", *bands)


def q_size_target_sample(spark, folder):
    """A byte target over the size of the selected partitions gives the probability."""
    source = table(spark, folder, "lineitem")
    size = runs.selected_bytes(source, [{"ship_year": "1997"}])
    rows = select.rows_of_specs(source, [{"ship_year": "1997"}])
    p = 100_000 / size if size else 1.0
    return sample.bernoulli_sample(rows, p, LINE_KEYS).select(*LINE_OUT)


# --- copies -----------------------------------------------------------------------------


def q_sample_copy(spark, folder):
    source = table(spark, folder, "lineitem")
    chosen = pin(select.matching(list_partitions(source), FILTER_SPECS))
    done = copy.sample_copy(spark, source, new_scratch(spark, "sample"), 0.1, LINE_KEYS, chosen)
    return done.frame.select(*LINE_OUT)


def q_surviving_partitions(spark, folder):
    """Partitions of a thin sample: those without a sampled row are gone."""
    source = table(spark, folder, "events")
    done = copy.sample_copy(spark, source, new_scratch(spark, "thin"), 0.005, ("event_id",))
    return list_partitions(done).select("name", "row_count")


EMPTY_MONTH = "2099-01"


def q_full_copy(spark, folder):
    """Every chosen partition is registered, also one that has no rows."""
    source = table(spark, folder, "orders")
    columns = list(source.partition_columns)
    chosen = list_partitions(source).select("order_month", "name")
    empty = local_rows(spark, [(EMPTY_MONTH, f"order_month={EMPTY_MONTH}")], chosen.schema)
    chosen = pin(chosen.unionByName(empty))
    path = new_scratch(spark, "orders")
    done = copy.full_copy(spark, source, path, chosen)
    name = f"{_database(spark)}.orders"
    register.register_copy(spark, name, done.frame.schema, columns, path)
    register.add_partitions(spark, name, chosen, columns, path)
    counts = spark.table(name).groupBy("order_month").agg(
        F.count("*").alias("n"), F.sum(F.col("o_orderkey")).alias("keys")
    )
    return (
        catalog_partitions(spark, name)
        .join(counts, "order_month", "left")
        .select("order_month", F.coalesce("n", F.lit(0)).alias("row_count"), "keys")
    )


def q_full_copy_bytes(spark, folder):
    """A run over a registered table that moves files: the last 23 months and an empty one."""
    laid = _laid_out(spark, table(spark, folder, "orders"))
    columns = list(laid.partition_columns)
    name = f"{_database(spark)}.orders"
    register.register_copy(spark, name, laid.frame.schema, columns, laid.location)
    empty = local_rows(
        spark, [(EMPTY_MONTH, f"order_month={EMPTY_MONTH}")], "order_month string, name string"
    )
    register.add_partitions(spark, name, empty, columns, laid.location)
    target = runs.RunTarget(new_scratch(spark, "moved"), _database(spark))
    runs.copy_tables(
        spark,
        {name: open_catalog(spark, name)},
        [TableSpec(name, partition_count=24)],
        target,
        CopyPolicy(byte_copy=True),
    )
    copied = f"{target.database}.orders"
    counts = spark.table(copied).groupBy("order_month").agg(F.count("*").alias("n"))
    return (
        catalog_partitions(spark, copied)
        .join(counts, "order_month", "left")
        .select("name", F.coalesce("n", F.lit(0)).alias("row_count"))
    )


def q_copy_files(spark, folder):
    """A byte copy of a laid-out table reads back like the original; all bytes arrived."""
    laid = _laid_out(spark, table(spark, folder, "lineitem"))
    columns = list(laid.partition_columns)
    target = new_scratch(spark, "bytes")
    report = copy.copy_files(spark, laid.location, target)
    short = copy.incomplete(report).agg(F.count("*").alias("incomplete_files"))
    moved = open_folder(spark, "lineitem", target, laid.frame.schema, laid.partition_columns)
    return _with_scalar(
        moved.frame.groupBy(*columns).agg(
            F.count("*").alias("row_count"), F.sum("l_orderkey").alias("keys")
        ),
        short,
    )


def _with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the values of a one-row frame as constants."""
    row = one_row.first()
    return df.select("*", *[F.lit(row[c]).cast(one_row.schema[c].dataType).alias(c) for c in one_row.columns])


def q_copy_files_report(spark, folder):
    """Byte copy of the given files themselves."""
    report = copy.copy_files(spark, folder, new_scratch(spark, "files"), "*.parquet")
    return report.select(
        F.regexp_extract("source", "[^/]*$", 0).alias("file"),
        F.regexp_extract("target", "[^/]*$", 0).alias("copy"),
        (F.col("expected") > 0).alias("has_bytes"),
        (F.col("expected") == F.col("copied")).alias("complete"),
    )


def q_copy_files_ranges(spark, folder):
    """The given files copied as ranges: the checksum of each file is its ranges' sums put together."""
    target = new_scratch(spark, "ranges")
    listing = files.walk_files(spark, folder, "*.parquet")
    report = transfer.whole(transfer.copy_listed(spark, listing, target, range_bytes=1 << 14), folder)
    again = transfer.file_checksums(spark, files.walk_files(spark, target), range_bytes=1 << 17)
    joined = report.join(again, report["target"] == again["path"])
    return joined.select(
        F.regexp_extract("relative", "^[^/.]*", 0).alias("file"), (F.col("sent") == F.col("checksum")).alias("same_sum")
    ).distinct()


def q_copy_loose_files(spark, folder):
    """Loose files keep their relative path below the target; the log has their full URIs."""
    root = new_scratch(spark, "loose")
    laid = _laid_out(spark, table(spark, folder, "orders"))
    target = runs.RunTarget(root, "lake", log=f"{root}/copy-log")
    runs.copy_tables(spark, {}, [], target, loose_files=[laid.location])
    logged = register.read_log(spark, target.log).where(
        (F.col("data_type") == register.FILES) & F.contains("statement", F.lit("/order_month="))
    )
    return logged.groupBy(
        paths.partition_value(F.col("statement"), "order_month").alias("order_month")
    ).agg(F.count_if(F.contains("statement", F.lit(f"{root}/"))).alias("uris")).select(
        "order_month", (F.col("uris") > 0).alias("logged")
    )


def q_two_hop_copy(spark, folder):
    laid = _laid_out(spark, table(spark, folder, "orders"))
    target = new_scratch(spark, "far")
    via = new_scratch(spark, "via")
    copy.copy_through(spark, laid.location, via, target)
    moved = open_folder(spark, "orders", target, laid.frame.schema, laid.partition_columns)
    return moved.frame.groupBy("order_month").agg(
        F.count("*").alias("row_count"), F.sum("o_orderkey").alias("keys")
    )


FIRST_DAYS_END = "2024-01-20"


def q_incremental_copy(spark, folder):
    """A sample of the earlier days, then a second run that brings only the later ones."""
    source = table(spark, folder, "events")
    columns = list(source.partition_columns)
    path = new_scratch(spark, "incremental")
    listed = list_partitions(source).select(*columns, "name")
    early = pin(listed.where(F.col("day") <= FIRST_DAYS_END))
    copy.sample_copy(spark, source, path, 0.03, ("event_id",), early)
    arrived = copy.incremental_copy(spark, source, path, listed, 0.03, ("event_id",))
    copied = open_folder(spark, "events", path, source.frame.schema, tuple(columns)).frame
    second = arrived.select(*columns).withColumn("arrived", F.lit("second"))
    return copied.join(second, columns, "left").select(
        "event_id", "day", "hour", F.coalesce("arrived", F.lit("first")).alias("arrived")
    )


def q_stream_incremental_copy(spark, folder):
    """The same two steps as a stream over an arriving folder tree, run twice plus once idle."""
    source = open_flat(spark, folder, "events", EVENT_DAY)
    columns = list(source.partition_columns)
    landing, target, state = (new_scratch(spark, x) for x in ("landing", "streamed", "state"))
    schema = source.frame.schema
    early = source.frame.where(F.col("day") <= FIRST_DAYS_END)
    late = source.frame.where(F.col("day") > FIRST_DAYS_END)
    for part in (early, late, None):
        if part is not None:
            copy.write_partitioned(part, landing, columns, mode="append")
        stream_copy(spark, landing, schema, columns, target, state, 0.1, ("event_id",))
    return open_folder(spark, "events", target, schema, tuple(columns)).frame.select("event_id", "day")


def q_stream_late_files(spark, folder):
    """The second batch's files are a year older than the first one's, as copies that keep
    file times are; nothing is lost."""
    source = open_flat(spark, folder, "events", EVENT_DAY)
    columns = list(source.partition_columns)
    landing, target, state = (new_scratch(spark, x) for x in ("landing", "streamed", "state"))
    schema = source.frame.schema
    early = source.frame.where(F.col("day") <= FIRST_DAYS_END)
    late = source.frame.where(F.col("day") > FIRST_DAYS_END)
    year = 365 * 86_400_000
    for part, age in ((early, 0), (late, year)):
        before = {r["path"] for r in files.list_files(spark, landing).collect()} if age else set()
        copy.write_partitioned(part, landing, columns, mode="append")
        if age:
            for row in files.list_files(spark, landing).collect():
                if row["path"] not in before:
                    storage.set_age(spark, row["path"], age)
        stream_copy(spark, landing, schema, columns, target, state)
    return open_folder(spark, "events", target, schema, tuple(columns)).frame.select("event_id", "day")


def q_stream_registered_copy(spark, folder):
    """A batch run, a stream, a replay of it without its checkpoint, and a batch run over one target,
    while files arrive in old and new months: as one batch run over all of them."""
    source = table(spark, folder, "orders")
    columns, orders = list(source.partition_columns), source.frame
    turn = F.pmod(F.col("o_orderkey"), F.lit(3))
    landing = new_scratch(spark, "landing")
    target = runs.RunTarget(f"{new_scratch(spark, 'shared')}/data", _database(spark))
    policy = CopyPolicy(sample_threshold=0, sample_keys={"orders": ("o_orderkey",)})
    states = [new_scratch(spark, "state") for _ in range(2)]

    def laid() -> SourceTable:
        return open_folder(spark, "orders", landing, orders.schema, tuple(columns))

    def batch() -> None:
        result = runs.copy_tables(spark, {"orders": laid()}, [TableSpec("orders", sample_prob=0.3)], target, policy)
        if result.errors:
            raise RuntimeError(str(result.errors))

    for n in range(3):
        copy.write_partitioned(orders.where(turn == n), landing, columns, mode="append")
        if n == 1:
            for state in states:
                stream_into_copy(spark, laid(), target, state, 0.3, policy)
        else:
            batch()
    return spark.table(target.table_of("orders")).select("o_orderkey", "order_month")


def _rerun(spark, folder, first: dict, second: dict, hook=None):
    """Two runs over the event hours into one target: the copy, its target and the second run."""
    root = new_scratch(spark, "rerun")
    database = _database(spark)
    target = runs.RunTarget(f"{root}/data", database)
    source = table(spark, folder, "events")
    policy = CopyPolicy(sample_threshold=0, sample_keys=KEYS)
    result = None
    for request in (first, second):
        spec = TableSpec("events", **request)
        result = runs.copy_tables(
            spark, {"events": source}, [spec], target, policy, before_sample=[hook] if hook else []
        )
        if result.errors:
            raise RuntimeError(str(result.errors))
    return spark.table(f"{database}.events"), target, result


def q_rerun_sample_then_full(spark, folder):
    """A tenth first, then everything: the copy is whole, not a mix."""
    copied, _, result = _rerun(spark, folder, {"sample_prob": 0.1}, {"sample_prob": 1.0})
    mode = F.lit(result.modes["events"])
    return copied.groupBy("day", "hour").agg(F.count("*").alias("row_count")).withColumn("mode", mode)


def q_rerun_with_hook(spark, folder):
    """The hook masks rows of the second run too."""

    def mask(rows: DataFrame) -> DataFrame:
        return rows.withColumn("event_type", F.lit("#"))

    days = tuple({"day": f"2024-01-{d:02d}"} for d in range(1, 11))
    first = {"sample_prob": 0.5, "partitions": days}
    copied, _, _ = _rerun(spark, folder, first, {"sample_prob": 0.5}, mask)
    return copied.select("event_id", "event_type", "day", "hour")


def q_rerun_adds_nothing(spark, folder):
    """A thin sample again: no partition is taken in twice and no row comes on top."""
    copied, target, _ = _rerun(spark, folder, {"sample_prob": 0.03}, {"sample_prob": 0.03})
    path = target.table_path("events")
    listed = list_partitions(table(spark, folder, "events"))
    source = table(spark, folder, "events")
    again = copy.incremental_copy(spark, source, path, listed.select("day", "hour", "name"), 0.03, KEYS["events"])
    recorded = copy.recorded_partitions(spark, path).agg(F.count("*").alias("taken_in"))
    counted = _with_scalar(copied.groupBy("day", "hour").agg(F.count("*").alias("row_count")), recorded)
    return _with_scalar(counted, again.agg(F.count("*").alias("added")))


_NEW_DAY = "2024-01-15"


def _grown(spark, folder, first, second, change, policy=CopyPolicy(sample_threshold=0, sample_keys=KEYS)):
    """Laid-out event hours, copied, changed by ``change(laid)``, and copied again."""
    source = table(spark, folder, "events")
    laid = copy.full_copy(spark, replace(source, frame=first(source.frame)), new_scratch(spark, "grown"))
    database = _database(spark)
    target = runs.RunTarget(f"{new_scratch(spark, 'rerun')}/data", database)
    result = None
    for step in (lambda t: t, lambda t: change(t) or second(t)):
        laid = step(laid)
        laid = open_folder(spark, "events", laid.location, laid.frame.schema, laid.partition_columns)
        result = runs.copy_tables(spark, {"events": laid}, [TableSpec("events", sample_prob=1.0)], target, policy)
        if result.errors:
            raise RuntimeError(str(result.errors))
    return laid, target, result


def q_rerun_changed_partition(spark, folder):
    """The hours of one day get their rows twice; only these are written again, and read so."""

    def double(laid: SourceTable) -> None:
        rows = laid.frame.where(F.col("day") == _NEW_DAY)
        copy.write_partitioned(rows, laid.location, laid.partition_columns, mode="append")

    same = lambda x: x
    _, target, result = _grown(spark, folder, same, same, double)
    copied = spark.table(target.table_of("events")).groupBy("day", "hour").agg(F.count("*").alias("row_count"))
    name = paths.partition_name(["day", "hour"])
    return copied.join(result.changes["events"].withColumnRenamed("name", "at"), name == F.col("at"), "left").select(
        "day", "hour", "row_count", F.coalesce("change", F.lit("")).alias("change")
    )


def q_rerun_new_hook(spark, folder):
    """A sample without a hook, then with one that masks: no row stays as it was."""

    def mask(rows: DataFrame) -> DataFrame:
        return rows.withColumn("event_type", F.lit("#"))

    root, database = new_scratch(spark, "rerun"), _database(spark)
    target = runs.RunTarget(f"{root}/data", database)
    policy = CopyPolicy(sample_threshold=0, sample_keys=KEYS)
    for before in ([], [mask]):
        sources = {"events": table(spark, folder, "events")}
        result = runs.copy_tables(spark, sources, [TableSpec("events", sample_prob=0.3)], target, policy, before)
        if result.errors:
            raise RuntimeError(str(result.errors))
    return spark.table(f"{database}.events").select("event_id", "event_type", "day", "hour")


def q_overlapping_runs(spark, folder):
    """A whole copy that begins while a sample is being made is refused: the copy is the sample alone."""
    target = runs.RunTarget(f"{new_scratch(spark, 'overlap')}/data", _database(spark))
    sources = {"events": table(spark, folder, "events")}
    inner = []

    def meanwhile(rows: DataFrame) -> DataFrame:
        if not inner:
            inner.append(runs.copy_tables(spark, sources, [TableSpec("events", sample_prob=1.0)], target))
        return rows

    policy = CopyPolicy(sample_threshold=0, sample_keys=KEYS)
    result = runs.copy_tables(spark, sources, [TableSpec("events", sample_prob=0.3)], target, policy, [meanwhile])
    if result.errors:
        raise RuntimeError(str(result.errors))
    refused = F.lit(inner[0].errors.get("events", "").partition(":")[0])
    return spark.table(target.table_of("events")).select("event_id", "day", "hour", refused.alias("refused"))


def q_rerun_new_column(spark, folder):
    """A column and half of the days come after the first run: the copy has both, older rows are null there."""
    events = table(spark, folder, "events").frame
    late = F.col("day") >= _NEW_DAY

    def grow(laid: SourceTable) -> None:
        copy.write_partitioned(events.where(late), laid.location, laid.partition_columns, mode="append")

    _, target, _ = _grown(
        spark,
        folder,
        lambda frame: frame.where(~late).drop("event_type"),
        lambda laid: open_folder(spark, "events", laid.location, events.schema, laid.partition_columns),
        grow,
    )
    return spark.table(target.table_of("events")).select("event_id", "event_type", "day", "hour")


def q_rerun_byte_copy(spark, folder):
    """Byte copies stay byte copies: after new and changed partitions, names and lengths are the source's."""
    events = table(spark, folder, "events").frame
    late = F.col("day") >= _NEW_DAY

    def grow(laid: SourceTable) -> None:
        copy.write_partitioned(events.where(late), laid.location, laid.partition_columns, mode="append")
        again = laid.frame.where(F.col("day") == "2024-01-03")
        copy.write_partitioned(again, laid.location, laid.partition_columns, mode="append")

    policy = CopyPolicy(sample_threshold=0, byte_copy=True)
    laid, target, _ = _grown(spark, folder, lambda frame: frame.where(~late), lambda x: x, grow, policy)
    here, there = (
        files.partition_folders(files.list_files(spark, at)).select("name", "files", "bytes")
        for at in (laid.location, target.table_path("events"))
    )
    named = [files.list_files(spark, at).select("relative", "length") for at in (laid.location, target.table_path("events"))]
    odd = named[0].exceptAll(named[1]).union(named[1].exceptAll(named[0])).agg(F.count("*").alias("odd_files"))
    same = here.join(there, ["name", "files", "bytes"], "left_semi").select("name")
    counts = spark.table(target.table_of("events")).groupBy("day", "hour").agg(F.count("*").alias("row_count"))
    return _with_scalar(counts.join(same, same["name"] == paths.partition_name(["day", "hour"]), "left_semi"), odd)


def q_moved_partition(spark, folder):
    """A registered table with one partition elsewhere: sizes, byte copy and cleanup see it."""
    laid = _laid_out(spark, table(spark, folder, "orders"))
    columns = list(laid.partition_columns)
    name = f"{_database(spark)}.orders"
    register.register_copy(spark, name, laid.frame.schema, columns, laid.location)
    first = catalog_partitions(spark, name).agg(F.min("order_month")).first()[0]
    away = new_scratch(spark, "away")
    storage.rename(spark, f"{laid.location}/order_month={first}", away)
    spark.sql(f"ALTER TABLE {name} PARTITION (order_month = '{first}') SET LOCATION '{away}'")
    source = open_catalog(spark, name)
    sizes = pin(located_partitions(spark, source))
    target = runs.RunTarget(new_scratch(spark, "moved"), _database(spark))
    runs.copy_tables(spark, {name: source}, [TableSpec(name, sample_prob=1.0)], target, CopyPolicy(byte_copy=True))
    counts = spark.table(f"{target.database}.orders").groupBy("order_month").agg(F.count("*").alias("row_count"))
    cleaning.cleanup(spark, [TableSpec(name)], CopyPolicy())
    gone = F.lit(not storage.exists(spark, away))
    return counts.join(sizes, "order_month").select(
        "order_month", "row_count", (F.col("bytes") > 0).alias("has_bytes"), gone.alias("folder_gone")
    )


def q_copy_run_two_databases(spark, folder):
    """Two tables of one short name in two databases stay two tables."""
    names = {}
    for kind in ("orders", "customer"):
        laid = _laid_out(spark, table(spark, folder, kind))
        database = _database(spark)
        register.register_copy(
            spark, f"{database}.t", laid.frame.schema, laid.partition_columns, laid.location
        )
        names[kind] = f"{database}.t"
    root = new_scratch(spark, "two")
    target = runs.RunTarget(f"{root}/data", log=f"{root}/data/copy-log")
    sources = {name: open_catalog(spark, name) for name in names.values()}
    specs = [TableSpec(name, sample_prob=1.0) for name in names.values()]
    result = runs.copy_tables(spark, sources, specs, target)
    counted = [
        result.tables[names[kind]].frame.agg(F.count("*").alias("row_count"), F.sum(key).alias("keys")).withColumn(
            "name", F.lit(kind)
        )
        for kind, key in (("orders", "o_orderkey"), ("customer", "c_custkey"))
    ]
    return counted[0].unionByName(counted[1])


def q_copy_local_attach(spark, folder):
    """Copies in a shared place are fetched; tables over the local files alone count the rows."""
    root, local = new_scratch(spark, "shared"), new_scratch(spark, "local")
    target = runs.RunTarget(root, "lake", log=f"{root}/copy-log")
    for name in ("lineitem", "orders"):
        source = table(spark, folder, name)
        done = copy.full_copy(spark, source, f"{root}/lake/{name}")
        listed = folder_partitions(spark, done).select("name")
        register.append_log(
            register.table_statements(
                listed, "lake", name, source.frame.schema, source.partition_columns,
                F.concat(F.lit(f"/lake/{name}/"), F.col("name")),
            ),
            target.log,
        )
    database = _database(spark)
    runs.copy_and_attach(spark, root, local, database=database)
    storage.remove(spark, f"{root}/lake")
    counts = [
        spark.table(f"{database}.{name}")
        .withColumn("is_local", F.contains(F.input_file_name(), F.lit(local)))
        .groupBy(paths.partition_name(LAYOUTS[name].columns).alias("name"))
        .agg(F.count("*").alias("row_count"), F.bool_and("is_local").alias("is_local"))
        for name in ("lineitem", "orders")
    ]
    return counts[0].unionByName(counts[1])


def q_staged_publish(spark, folder):
    """Only the published copy is left; its staging folder is gone."""
    source = open_flat(spark, folder, "events", EVENT_DAY)
    target = f"{new_scratch(spark, 'publish')}/events"
    copy.staged_publish(
        spark, lambda path: copy.sample_copy(spark, source, path, 0.1, ("event_id",)), target
    )
    siblings = files.list_files(spark, target.rpartition("/")[0]).agg(
        F.count_if(F.contains("path", F.lit(copy.STAGING_HINT))).alias("staged_files")
    )
    done = open_folder(spark, "events", target, source.frame.schema, source.partition_columns)
    return _with_scalar(list_partitions(done).select("name", "row_count"), siblings)


def q_sweep_leftovers(spark, folder):
    """Runs that died at each step: one sweep leaves the copies whole and nothing else."""
    root, database = new_scratch(spark, "swept"), _database(spark)
    copies = {name: copy.full_copy(spark, table(spark, folder, name), f"{root}/{name}") for name in ("events", "orders")}
    for name, done in copies.items():
        register.register_copy(spark, f"{database}.{name}", done.frame.schema, done.partition_columns, done.location)
    # While writing, between the two moves of a partition and of a whole copy, and within a byte copy.
    copy.write_partitioned(table(spark, folder, "customer").frame, copy.staging_path(f"{root}/customer"), [])
    copy.write_partitioned(table(spark, folder, "orders").frame, copy.staging_path(f"{root}/orders"), ["order_month"])
    storage.rename(spark, f"{root}/orders", copy.staging_path(f"{root}/orders", copy.ASIDE))
    aside, day = copy.staging_path(f"{root}/events", copy.SWAPPED), "day=2024-01-05"
    storage.rename(spark, f"{root}/events/{day}", f"{aside}/{day}")
    storage.write_text(spark, f"{root}/events/{day}/.part-0.parquet.{uuid.uuid4().hex}", "half of a file")
    swept = sweep.sweep(spark, sweep.leftovers(spark, [root], 0, [database]))
    left = sweep.leftovers(spark, [root], 0, [database]).agg(F.count("*").alias("left_over"))
    parts = [
        list_partitions(open_folder(spark, name, done.location, done.frame.schema, done.partition_columns)).select(
            F.lit(name).alias("copy"), "name", "row_count"
        )
        for name, done in copies.items()
    ]
    whole = parts[0].unionByName(parts[1]).withColumn("restored", F.lit(swept["restored"]).cast("long"))
    return _with_scalar(whole, left)


def q_copy_with_hooks(spark, folder):
    """A hook masks a column before the write; another copies side files after it."""
    source = table(spark, folder, "customer")
    plain = _laid_out(spark, source)
    segments = source.frame.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    notes = segments.select(F.concat_ws("=", "c_mktsegment", "n").alias("line")).coalesce(1)
    copy.write_partitioned(notes, f"{plain.location}/notes.meta", [], storage=TEXT)

    def mask(rows: DataFrame) -> DataFrame:
        return rows.withColumn("c_name", F.regexp_replace("c_name", "[0-9]", "#"))

    rows_only = formats.StorageFormat("parquet", {"pathGlobFilter": "*.parquet"})
    data = open_folder(spark, "customer", plain.location, source.frame.schema, storage=rows_only)
    path = new_scratch(spark, "hooked")
    done = copy.sample_copy(spark, data, path, 0.5, ("c_custkey",), before_sample=[mask])
    hooks.copy_side_files("*.txt")(hooks.CopyContext(spark, data, done, "sample"))
    copied = spark.read.text(f"{path}/notes.meta").agg(F.count("*").alias("side_lines"))
    return _with_scalar(done.frame.select("c_custkey", "c_name", "c_mktsegment"), copied)


def q_format_roundtrip(spark, folder):
    """Each storage format gives back the same rows."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    kinds = {
        "parquet": formats.PARQUET,
        "orc": formats.ORC,
        "json": formats.JSON,
        "textfile": formats.from_hive_clause("TEXTFILE"),
        "delimited": formats.delimited(fields=";", escape="!", null="~"),
    }
    result = None
    for name, kind in kinds.items():
        path = new_scratch(spark, name)
        copy.write_partitioned(part, path, [], storage=kind)
        rows = kind.read(spark, path, part.schema).withColumn("stored_as", F.lit(name))
        result = rows if result is None else result.unionByName(rows)
    return result


def q_text_lines_roundtrip(spark, folder):
    """Whole documents, line breaks and all, through delimited text."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    path = new_scratch(spark, "lines")
    kind = formats.delimited(escape='"', multiline=True)
    copy.write_partitioned(documents, path, [], storage=kind)
    back = kind.read(spark, path, documents.schema)
    return back.withColumn("text", F.md5("text")).withColumnRenamed("text", "digest")


def q_nested_text_roundtrip(spark, folder):
    """Arrays and maps in a delimited table, by collection and key delimiters."""
    rows = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id",
        F.split("event_type", "i").alias("pieces"),
        F.from_json("props", "map<string,string>").alias("props"),
    )
    path = new_scratch(spark, "nested")
    kind = formats.delimited(fields="|")
    packed = formats.pack_collections(rows)
    copy.write_partitioned(packed, path, [], storage=kind)
    back = formats.unpack_collections(kind.read(spark, path, packed.schema), rows.schema)
    return back.select(
        "event_id", F.array_join("pieces", "i").alias("event_type"), F.element_at("props", "k").alias("k")
    )


# --- catalog, log, cleanup --------------------------------------------------------------


def q_schema_clone(spark, folder):
    """A table made like another, filled; its columns with type and non-null count."""
    source = table(spark, folder, "lineitem")
    laid = _laid_out(spark, SourceTable("lineitem", spark.read.parquet(f"{folder}/lineitem.parquet")))
    database = _database(spark)
    register.register_copy(spark, f"{database}.original", laid.frame.schema, [], laid.location)
    register.create_like(spark, f"{database}.clone", f"{database}.original", new_scratch(spark, "clone"))
    spark.table(f"{database}.original").write.insertInto(f"{database}.clone")
    clone = open_catalog(spark, f"{database}.clone").frame
    counted = clone.agg(*[F.count(c).alias(c) for c in clone.columns])
    items = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("name"),
            F.lit(kind).alias("type"),
            F.lit(nullable).alias("nullable"),
            F.col(name).alias("filled"),
        )
        for position, name, kind, nullable in column_definitions(clone.schema)
    ]
    return counted.select(F.inline(F.array(*items)))


LOG_TIMES = {"orders": "2024-02-01 10:00:00", "events": "2024-04-01 09:30:00", "files": "2024-03-05 23:00:01"}


def _written_log(spark, folder) -> str:
    log = new_scratch(spark, "log")
    for name, database in (("events", "lake"), ("orders", "lake")):
        source = table(spark, folder, name)
        listed = list_partitions(source).select("name")
        location = F.concat(F.lit(f"hdfs://primary/{database}/{name}/"), F.col("name"))
        statements = register.table_statements(
            listed, database, name, source.frame.schema, source.partition_columns, location
        )
        moment = F.lit(LOG_TIMES[name]).cast("timestamp")
        register.append_log(statements, log, register.HIVE, moment, "tester")
    listing = list_partitions(table(spark, folder, "lineitem")).select(
        F.concat("name", F.lit("/rows.parquet")).alias("relative")
    )
    register.append_log(
        register.file_statements(listing, "s3a://shared/loose"),
        log,
        register.FILES,
        F.lit(LOG_TIMES["files"]).cast("timestamp"),
        "tester",
    )
    return log


def q_copy_log(spark, folder):
    """Blocks of two tables and of loose files, described in order of writing."""
    return register.describe_log(register.read_log(spark, _written_log(spark, folder)))


def q_attach(spark, folder):
    """Replay the table statements of a log elsewhere, and count rows through the catalog."""
    root = new_scratch(spark, "shared")
    log = f"{root}/copy-log"
    for name in ("lineitem", "orders"):
        source = table(spark, folder, name)
        done = copy.full_copy(spark, source, f"{root}/lake/{name}")
        location = F.concat(F.lit(f"/lake/{name}/"), F.col("name"))
        listed = folder_partitions(spark, done).select("name")
        register.append_log(
            register.table_statements(
                listed, "lake", name, source.frame.schema, source.partition_columns, location
            ),
            log,
        )
    database = _database(spark)
    register.attach(spark, register.read_log(spark, log), root, database)
    counts = [
        spark.table(f"{database}.{name}")
        .groupBy(paths.partition_name(LAYOUTS[name].columns).alias("name"))
        .agg(F.count("*").alias("row_count"))
        for name in ("lineitem", "orders")
    ]
    return counts[0].unionByName(counts[1])


ACCEPTANCE = "SELECT day, hour, count(*) AS row_count FROM {table} WHERE day >= '2024-01-29' GROUP BY day, hour"


def q_partition_count_query(spark, folder):
    """The acceptance query on a registered sample of the last 48 partitions, as SQL text."""
    source = table(spark, folder, "events")
    columns = list(source.partition_columns)
    chosen = pin(select.last_n(list_partitions(source), 48))
    path = new_scratch(spark, "accept")
    done = copy.sample_copy(spark, source, path, 0.5, ("event_id",), chosen)
    name = f"{_database(spark)}.events"
    register.register_copy(spark, name, done.frame.schema, columns, path)
    return register.run_statements(spark, [ACCEPTANCE.format(table=name)])


def q_cleanup(spark, folder):
    """What is left when the last 12 partitions of one copy go and another copy is kept."""
    database = _database(spark)
    for name in ("lineitem", "orders", "customer"):
        done = _laid_out(spark, table(spark, folder, name))
        register.register_copy(
            spark, f"{database}.{name}", done.frame.schema, done.partition_columns, done.location
        )
    cleaning.cleanup(
        spark,
        [
            TableSpec(f"{database}.lineitem", partition_count=12),
            TableSpec(f"{database}.orders", skip_cleanup=True),
            TableSpec(f"{database}.customer"),
            TableSpec(f"{database}.returns"),
        ],
        CopyPolicy(),
    )
    left = None
    for name, columns in (("lineitem", ["ship_year", "ship_month"]), ("orders", ["order_month"])):
        rows = (
            spark.table(f"{database}.{name}")
            .groupBy(paths.partition_name(columns).alias("name"))
            .agg(F.count("*").alias("row_count"))
            .withColumn("copy", F.lit(name))
        )
        left = rows if left is None else left.unionByName(rows)
    gone = F.lit(not spark.catalog.tableExists(f"{database}.customer"))
    return left.withColumn("plain_copy_gone", gone)


# --- ledger -----------------------------------------------------------------------------


def _ledger_rows(spark, folder) -> DataFrame:
    """A ledger over event partitions: state by the name's digest, duration by its rows."""
    listed = list_partitions(table(spark, folder, "events"))
    digit = F.substring(F.md5("name"), 1, 1)
    state = (
        F.when(digit < "8", F.lit("finished"))
        .when(digit < "b", F.lit("failed"))
        .when(digit < "d", F.lit("invalid"))
        .otherwise(F.lit("todo"))
    )
    end = F.to_timestamp_ntz(F.concat("day", F.lit(" "), "hour", F.lit(":59:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    start = F.to_timestamp_ntz(F.concat("day", F.lit(" "), "hour", F.lit(":00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    first = listed.select(
        F.col("name").alias("item"), F.lit("todo").alias("state"), start.alias("updated"),
        F.lit(0).cast("long").alias("seconds"), F.lit(None).cast("string").alias("message"),
    )
    last = listed.select(
        F.col("name").alias("item"), state.alias("state"), end.alias("updated"),
        (F.col("row_count") * 60).alias("seconds"), F.lit(None).cast("string").alias("message"),
    )
    path = new_scratch(spark, "ledger")
    first.write.parquet(path)
    last.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def q_copy_report(spark, folder):
    return ledger.report(_ledger_rows(spark, folder))


def q_run_totals(spark, folder):
    return ledger.run_totals(_ledger_rows(spark, folder))


def q_resume_ledger(spark, folder):
    """The ledger knows all event hours; the months of orders are new, and of the hours only
    those that a digest picks are still configured."""
    known = _ledger_rows(spark, folder)
    events = _pinned_partitions(spark, folder, "events")
    wanted = events.where(F.substring(F.md5(F.reverse("name")), 1, 1) < "c").select(F.col("name").alias("item"))
    months = list_partitions(table(spark, folder, "orders")).select(F.col("name").alias("item"))
    return ledger.next_run(wanted.unionByName(months), known)


def _ledger_in_steps(spark, folder) -> str:
    """The ledger as runs append it: all are to do, then one entry per final state, compacted twice on the way."""
    path = new_scratch(spark, "ledger")
    rows = _ledger_rows(spark, folder).select(LEDGER_SCHEMA.names)
    rows.where("seconds = 0").write.parquet(f"{path}/entry-first")
    for n, state in enumerate(("finished", "failed", "invalid", "todo")):
        rows.where((F.col("state") == state) & (F.col("seconds") > 0)).write.parquet(f"{path}/entry-{n}")
        if n < 2:
            ledger.compact(spark, path, grace=0)
    return path


def q_compacted_ledger(spark, folder):
    """The state of every item, from a snapshot and the entries after it."""
    return ledger.latest(ledger.open_ledger(spark, _ledger_in_steps(spark, folder))).select("item", "state", "seconds")


def q_compacted_log(spark, folder):
    """A log whose blocks became one snapshot reads as before."""
    log = _written_log(spark, folder)
    register.compact_log(spark, log, grace=0)
    return register.describe_log(register.read_log(spark, log))


def q_bucketed_copy(spark, folder):
    """Orders whole and lineitem as a sample, both copied from bucketed tables and joined bucket by bucket."""
    root, database = new_scratch(spark, "bucketed"), _database(spark)
    for name, key, p in (("orders", "o_orderkey", 1.0), ("lineitem", "l_orderkey", 0.3)):
        flat = open_flat(spark, folder, name)
        clustered = bucketed.Buckets(8, (key,), (key,))
        made = bucketed.bucketed_copy(spark, flat, f"{database}.{name}_made", f"{root}/{name}-made", buckets=clustered)
        bucketed.bucketed_copy(spark, made, f"{database}.{name}", f"{root}/{name}", p, KEYS[name])
    orders, lines = spark.table(f"{database}.orders"), spark.table(f"{database}.lineitem")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("row_count"), F.sum("l_linenumber").cast("long").alias("numbers"))


# --- paths ------------------------------------------------------------------------------


def _pinned_partitions(spark, folder, name: str) -> DataFrame:
    """A pinned list: filters on names then run on the list, not on the table's rows."""
    return pin(list_partitions(table(spark, folder, name)), "partitions")


def _line_paths(spark, folder) -> DataFrame:
    listed = _pinned_partitions(spark, folder, "lineitem")
    return listed.select(
        "name",
        F.concat(F.lit("hdfs://primary:8020/lake/lineitem/"), F.col("name"), F.lit("/rows.parquet")).alias("path"),
    )


def q_path_functions(spark, folder):
    base = "/lake/lineitem"
    pairs = paths.partition_pairs(F.col("name"))
    relative = paths.strip_authority(F.col("path"))
    typed = {"ship_year": "int", "ship_month": "string"}
    return _line_paths(spark, folder).select(
        "name",
        relative.alias("relative"),
        paths.parent(F.col("path")).alias("parent"),
        paths.to_location_variable(F.col("path")).alias("variable"),
        paths.from_location_variable(paths.to_location_variable(F.col("path")), "s3a://shared").alias("resolved"),
        paths.storage_uri(F.col("path"), "s3a", "shared").alias("uri"),
        paths.path_below(relative, base).alias("below"),
        paths.path_below(relative, base, include_base=True).alias("below_with_base"),
        paths.is_below(relative, base).alias("is_below"),
        paths.spec_text(pairs, typed).alias("spec"),
        paths.spec_text(pairs, typed, " and ").alias("filter"),
        paths.column_list(pairs).alias("columns"),
        paths.partition_map(F.col("name"))["ship_month"].alias("month"),
        F.array_join(paths.csv_items(F.concat_ws(" , ", pairs["column"])), "+").alias("items"),
    )


def q_common_location(spark, folder):
    """All partition folders must lie below the table's; folders per first level, checked."""
    base = "/lake/lineitem"
    listed = _line_paths(spark, folder).select(paths.strip_authority(F.col("path")).alias("path"))
    inside = copy.common_location(listed, base)
    return inside.groupBy(paths.first_level_dir(F.col("path"), base).alias("folder")).agg(
        F.count("*").alias("locations")
    )


def q_time_texts(spark, folder):
    """Event times as sortable and readable text and back; epoch milliseconds."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    whole = F.date_trunc("second", "ts").cast("timestamp_ntz")
    sortable = clock.sortable_text(whole)
    millis = F.unix_millis(whole.cast("timestamp"))
    return events.select(
        "event_id",
        sortable.alias("sortable"),
        clock.readable_text(clock.parse_sortable(sortable)).alias("readable"),
        clock.readable_text(clock.from_epoch_millis(millis)).alias("from_millis"),
    )


def q_first_level_dirs(spark, folder):
    lines = _line_paths(spark, folder).select(paths.strip_authority(F.col("path")).alias("path"))
    months = _pinned_partitions(spark, folder, "orders")
    logs = months.select(F.concat(F.lit("/lake/lineitem/copy-log/"), "name").alias("path"))
    folders = files.first_level_folders(lines.unionByName(logs), "/lake/lineitem")
    return files.names_with_prefix(folders, "/lake/lineitem/ship_year=199")


# --- registry ---------------------------------------------------------------------------


def q_parent_child_rollup(spark, folder):
    """Customers and their orders, some without any; labels and documents, some not labelled."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    both = [
        registry.rollup_children(customers, orders, "c_custkey", "o_custkey", "o_orderkey"),
        registry.rollup_children(labels, documents, "doc_id", "doc_id", "n_chars"),
    ]
    return both[0].withColumn("of", F.lit("orders")).unionByName(both[1].withColumn("of", F.lit("documents")))


def q_parent_child_members(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return registry.child_members(orders, lines, "o_orderkey", "l_orderkey", "l_partkey")


def q_orphans(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    talks = spark.read.parquet(f"{folder}/conversations.parquet")
    return registry.orphans(labels, talks, "doc_id", "conv_id").select("conv_id", "turn", "role")


def _expiring(spark, folder) -> DataFrame:
    """Orders as copies: expiry text from the date, missing or unreadable for some priorities."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("junk"))
        .otherwise(clock.readable_text(F.col("o_orderdate")))
    )
    return orders.select(
        F.col("o_orderkey").alias("copy_id"),
        (F.col("o_orderstatus") != "F").alias("running"),
        text.alias("expires"),
    )


NOW = "1998-08-02 12:00:00"


def q_expired_copies(spark, folder):
    copies = _expiring(spark, folder)
    now = F.lit(NOW).cast("timestamp_ntz")
    return copies.where(clock.is_expired(F.col("running"), F.col("expires"), now))


def q_extend_expiry(spark, folder):
    now = F.lit(NOW).cast("timestamp_ntz")
    extended = clock.extended_expiry(F.col("expires"), now)
    return _expiring(spark, folder).where("running").select(
        "copy_id",
        clock.readable_text(extended).alias("extended"),
        extended.isNull().alias("refused"),
        clock.readable_text(clock.extended_expiry(F.col("expires"), now, reset=True)).alias("reset"),
    )


def _tagged(spark, folder) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    props = F.from_json("props", "map<string,string>")
    owned = F.create_map(F.lit("user.type"), F.col("event_type"), F.lit("owner"), F.col("user_id").cast("string"))
    return events.select("event_id", F.map_concat(props, owned).alias("tags"))


def q_tag_lookup(spark, folder):
    return _tagged(spark, folder).where(tags.tag_equals(F.col("tags"), "k", "69")).select(
        "event_id", F.col("tags")["owner"].alias("owner")
    )


def q_tag_edit(spark, folder):
    """User tags with their prefix off, one tag set, one removed."""
    user = tags.tags_with_prefix(F.col("tags"), "user.")
    edited = tags.remove_tag(tags.set_tag(F.col("tags"), "k", "seen"), "owner")
    return _tagged(spark, folder).select(
        "event_id",
        F.to_json(user).alias("user_tags"),
        F.element_at(edited, "k").alias("k"),
        F.size(edited).cast("long").alias("tag_count"),
    )


# --- whole runs -------------------------------------------------------------------------

RUN_SPECS = [
    TableSpec("lineitem", sample_prob=0.1, partitions=({"ship_year": "1996"}, {"ship_year": "1997"})),
    TableSpec("events", partition_count=48, sample_prob=0.5),
    TableSpec("orders", top_level_count=12, sample_prob=1.0),
    TableSpec("customer", sample_prob=0.2),
    TableSpec("nation", sample_prob=0.2),
    TableSpec("part", sample_prob=0.3, partitions=({"brand": "x"},)),
    TableSpec("returns", sample_prob=0.2),
]
RUN_POLICY = CopyPolicy(
    sample_threshold=1_000,
    table_parallelism=4,
    sample_keys={**KEYS, "customer": ("c_custkey",), "part": ("p_partkey",)},
)


def _whole_run(spark, folder) -> tuple[runs.RunResult, runs.RunTarget]:
    root = new_scratch(spark, "run")
    database = f"sluice_{uuid.uuid4().hex}"
    register.create_database(spark, database, f"{root}/database")
    target = runs.RunTarget(f"{root}/data", database, f"{root}/ledger", f"{root}/data/copy-log")
    sources = {}
    for spec in RUN_SPECS:
        try:
            sources[spec.name] = table(spark, folder, spec.name)
        except UnresolvedRequest:
            continue

    def refuse_parts(context: hooks.CopyContext) -> None:
        if context.source.name == "part":
            raise RuntimeError("refused")

    result = runs.copy_tables(
        spark, sources, RUN_SPECS, target, RUN_POLICY, after_copy=[refuse_parts]
    )
    return result, target


def q_copy_run(spark, folder):
    """A whole run: rows per copied table through the catalog, and how it was copied."""
    result, target = _whole_run(spark, folder)
    counted = None
    for name in sorted(result.tables):
        rows = spark.table(f"{target.database}.{name}").agg(F.count("*").alias("row_count"))
        rows = rows.select(F.lit(name).alias("name"), F.lit(result.modes[name]).alias("mode"), "row_count")
        counted = rows if counted is None else counted.unionByName(rows)
    return counted


def q_copy_run_states(spark, folder):
    """The ledger after a run: finished, failed and invalid items, each once."""
    _, target = _whole_run(spark, folder)
    return ledger.latest(ledger.open_ledger(spark, target.ledger)).select("item", "state")


def registered() -> dict[str, Query]:
    """All queries by name."""
    return {name[2:]: value for name, value in globals().items() if name.startswith("q_")}
