"""Which partitions of a table a request takes, and the rows that belong to them."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sluice.functions import paths
from sluice.model import PartitionSpec, UnresolvedRequest
from sluice.session import local_rows, pin
from sluice.sources.layouts import Layout
from sluice.sources.tables import SourceTable

# Up to this many specs are one OR-of-AND predicate; more become a join, because a very
# long predicate no longer compiles into one code-generated stage.
PREDICATE_LIMIT = 200

_GROUP_LIMIT_KEY = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 64


# --- last N -----------------------------------------------------------------------------


def last_n(partitions: DataFrame, n: int) -> DataFrame:
    """Last ``n`` partitions in name order; ``n <= 0`` keeps all.

    A top-k, so every task sends ``n`` names at most; no global window.
    """
    return partitions if n <= 0 else partitions.orderBy(F.desc("name")).limit(n)


def last_n_top_level(partitions: DataFrame, n: int) -> DataFrame:
    """All partitions below the last ``n`` top-level folders, in name order.

    The list is read twice, so it is pinned first.
    """
    if n <= 0:
        return partitions
    columns = partitions.columns
    listed = pin(partitions.withColumn("__top", F.substring_index("name", "/", 1)), "partitions")
    top = listed.select("__top").distinct().orderBy(F.desc("__top")).limit(n)
    return listed.join(top, "__top", "left_semi").select(*columns)


# --- specs ------------------------------------------------------------------------------


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name.lower(): f.dataType for f in df.schema}


def spec_predicate(spec: PartitionSpec, types: Mapping[str, T.DataType]) -> Column:
    """AND of typed equalities. A spec may bind some of the partition columns only.

    Values are taken as text, whatever they come as, so that short and long lists of specs
    agree. The value None stands for the null partition.
    """
    terms = []
    for name, value in spec.items():
        kind = types.get(name.lower())
        if kind is None:
            raise UnresolvedRequest(f"invalid column: {name}")
        if value is None:
            terms.append(F.col(name).isNull())
            continue
        literal = F.lit(_text(value)).cast(kind)
        terms.append(F.col(name) == literal)
    return functools.reduce(lambda a, b: a & b, terms, F.lit(True))


def partition_filter(specs: Sequence[PartitionSpec], types: Mapping[str, T.DataType]) -> Column:
    """OR over specs of AND over columns."""
    return functools.reduce(lambda a, b: a | b, [spec_predicate(s, types) for s in specs], F.lit(False))


def _by_columns(specs: Sequence[PartitionSpec]) -> dict[tuple[str, ...], list[tuple[int, PartitionSpec]]]:
    groups: dict[tuple[str, ...], list[tuple[int, PartitionSpec]]] = {}
    for i, spec in enumerate(specs):
        groups.setdefault(tuple(sorted(spec)), []).append((i, spec))
    return groups


def _text(value) -> str | None:
    return None if value is None else str(value)


def _join_specs(df: DataFrame, frame: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Equi join that lets null partition values meet; the frame's columns are dropped."""
    renamed = frame.select(
        *[F.col(c).alias(f"__spec_{c}") if c in columns else F.col(c) for c in frame.columns]
    )
    on = [df[c].eqNullSafe(renamed[f"__spec_{c}"]) for c in columns]
    return df.join(renamed, on, how).drop(*[f"__spec_{c}" for c in columns])


def _spec_frame(df: DataFrame, columns: tuple[str, ...], specs, with_id: bool) -> DataFrame:
    types = _types(df)
    unknown = [c for c in columns if c.lower() not in types]
    if unknown:
        raise UnresolvedRequest(f"invalid column: {unknown[0]}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if with_id:
        text = text.add("spec_id", T.IntegerType())
        rows = [(*[_text(s[c]) for c in columns], i) for i, s in specs]
    else:
        rows = list(dict.fromkeys(tuple(_text(s[c]) for c in columns) for _, s in specs))
    frame = local_rows(df.sparkSession, rows, text)
    extra = ["spec_id"] if with_id else []
    return frame.select(*[F.col(c).cast(types[c.lower()]).alias(c) for c in columns], *extra)


def matching(df: DataFrame, specs: Sequence[PartitionSpec]) -> DataFrame:
    """Rows (or partitions) that any spec matches. No specs means everything.

    The long form also gets an IN list per column that all specs bind. It is a plain
    partition filter, so folders are pruned before any file is listed for reading.
    """
    if not specs:
        return df
    if len(specs) <= PREDICATE_LIMIT:
        return df.where(partition_filter(specs, _types(df)))
    groups = _by_columns(specs)
    shared = set.intersection(*[set(g) for g in groups])
    types = _types(df)
    for column in sorted(shared):
        values = {_text(s[column]) for s in specs}
        if None not in values:
            df = df.where(F.col(column).isin([F.lit(v).cast(types[column.lower()]) for v in sorted(values)]))
    if len(groups) == 1:
        ((columns, members),) = groups.items()
        return _join_specs(df, _spec_frame(df, columns, members, False), columns, "left_semi")
    kept = df.columns
    hits = []
    for i, (columns, members) in enumerate(groups.items()):
        hit = f"__hit_{i}"
        frame = _spec_frame(df, columns, members, False).withColumn(hit, F.lit(True))
        df = _join_specs(df, frame, columns, "left")
        hits.append(F.coalesce(F.col(hit), F.lit(False)))
    return df.where(functools.reduce(lambda a, b: a | b, hits)).select(*kept)


def tag_with_specs(partitions: DataFrame, specs: Sequence[PartitionSpec]) -> DataFrame:
    """One row per partition and matching spec, with ``spec_id``."""
    if len(specs) <= PREDICATE_LIMIT:
        types = _types(partitions)
        ids = F.array(*[F.when(spec_predicate(s, types), F.lit(i)) for i, s in enumerate(specs)])
        return partitions.select("*", F.explode(F.array_compact(ids)).alias("spec_id"))
    listed = pin(partitions, "partitions")
    branches = [
        _join_specs(listed, _spec_frame(listed, columns, members, True), columns, "inner").select(
            *partitions.columns, "spec_id"
        )
        for columns, members in _by_columns(specs).items()
    ]
    return functools.reduce(DataFrame.unionByName, branches)


def last_n_per_spec(partitions: DataFrame, specs: Sequence[PartitionSpec], n: int) -> DataFrame:
    """Last ``n`` partitions of every spec, then the distinct union.

    Up to the optimizer's group-limit threshold each task keeps ``n`` rows per spec
    before the shuffle. A larger cap takes a first round on salted groups, so that a
    spec that matches most partitions is not ranked in one task from scratch.
    """
    if n <= 0:
        return matching(partitions, specs)
    tagged = tag_with_specs(partitions, specs)
    by_name = F.desc("name")
    threshold = int(partitions.sparkSession.conf.get(_GROUP_LIMIT_KEY, "1000"))
    if n > threshold:
        salted = tagged.withColumn("__salt", F.pmod(F.xxhash64("name"), F.lit(_SALTS)))
        first = Window.partitionBy("spec_id", "__salt").orderBy(by_name)
        tagged = salted.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= n)
    ranked = tagged.withColumn(
        "__rank", F.row_number().over(Window.partitionBy("spec_id").orderBy(by_name))
    )
    return ranked.where(F.col("__rank") <= n).select(*partitions.columns).distinct()


def unmatched_specs(partitions: DataFrame, specs: Sequence[PartitionSpec]) -> list[PartitionSpec]:
    """Specs without any partition: one aggregate row, or an anti join for long lists."""
    if not specs:
        return []
    if len(specs) <= PREDICATE_LIMIT:
        types = _types(partitions)
        found = partitions.agg(
            *[
                F.coalesce(F.max(spec_predicate(s, types)), F.lit(False)).alias(f"s{i}")
                for i, s in enumerate(specs)
            ]
        ).first()
        return [s for i, s in enumerate(specs) if not found[f"s{i}"]]
    missing = []
    for columns, members in _by_columns(specs).items():
        left = _spec_frame(partitions, columns, members, True)
        ids = _join_specs(left, partitions.select(*columns).distinct(), columns, "left_anti")
        missing += [r["spec_id"] for r in ids.select("spec_id").collect()]
    return [specs[i] for i in sorted(missing)]


def resolve(
    partitions: DataFrame,
    specs: Sequence[PartitionSpec] = (),
    cap: int = -1,
    top_level_cap: int = -1,
) -> DataFrame:
    """The partitions a request selects. A spec that matches nothing is an error.

    With specs the list is read twice, so it is pinned first.
    """
    if specs:
        partitions = pin(partitions, "partitions")
        missing = unmatched_specs(partitions, specs)
        if missing:
            text = ", ".join(f"{k}={v}" for k, v in missing[0].items())
            raise UnresolvedRequest(f"spec has no partition: {text}")
        chosen = last_n_per_spec(partitions, specs, cap)
    else:
        chosen = last_n(partitions, cap)
    if top_level_cap > 0:
        chosen = last_n_top_level(chosen, top_level_cap)
    return chosen


# --- rows of selected partitions --------------------------------------------------------


def rows_of(
    df: DataFrame, chosen: DataFrame, columns: Sequence[str], layout: Layout | None = None
) -> DataFrame:
    """Rows of ``df`` in the partitions of a pinned frame ``chosen``.

    ``chosen`` must come from :func:`sluice.session.pin`: its file size tells Catalyst
    whether it may be broadcast, and AQE splits a hot partition otherwise. The value
    range of the first column is a static partition filter and makes the other columns
    prune dynamically. With the layout that the columns derive from, that range is one on
    the time column, which reaches the scan. Null partition values match each other.
    """
    first = columns[0]
    some_null = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    found = chosen.agg(
        F.count("*").alias("n"),
        F.min(first).alias("low"),
        F.max(first).alias("high"),
        F.coalesce(F.max(some_null), F.lit(False)).alias("nulls"),
    ).first()
    if found["n"] == 0:
        return df.where(F.lit(False))
    keys = chosen.select(*columns)
    if found["nulls"]:
        return _join_specs(df, keys, columns, "left_semi")
    inside = F.col(first).between(found["low"], found["high"])
    times = None if layout is None else layout.time_bounds([{first: found["low"]}, {first: found["high"]}])
    rows = df.where(inside) if times is None else df.where(times)
    return rows.join(keys.where(inside), list(columns), "left_semi")


def rows_of_specs(table: SourceTable, specs: Sequence[PartitionSpec]) -> DataFrame:
    """Rows of a table that the specs select.

    A derived layout turns specs into ranges on its time column, which the scan can use;
    a laid-out table prunes folders by the partition columns themselves.
    """
    if table.layout is not None and table.location is None and specs:
        ranges = table.layout.time_filter(specs)
        if ranges is not None:
            return table.frame.where(ranges)
        bounds = table.layout.time_bounds(specs)
        if bounds is not None:
            return matching(table.frame.where(bounds), specs)
    return matching(table.frame, specs)


def specs_from_text(spark, texts: Sequence[str]) -> list[tuple[str | None, list[dict[str, str]]]]:
    """Request texts ``db.table (a='1', b=2) (…)`` as name and specs; name None if unreadable."""
    rows = local_rows(spark, [(i, t) for i, t in enumerate(texts)], "i int, text string")
    parsed = rows.select(
        "i",
        paths.request_table(F.col("text")).alias("name"),
        paths.request_specs(F.col("text")).alias("specs"),
    )
    return [(r["name"], r["specs"]) for r in parsed.orderBy("i").collect()]
