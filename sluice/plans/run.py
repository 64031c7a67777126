"""A copy run: resolve, size, decide, copy, register, log, record, report."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import storage
from sluice.functions import paths
from sluice.functions.ddl import quoted_name
from sluice.model import (
    FAILED,
    FINISHED,
    FULL,
    INVALID,
    LEDGER_SCHEMA,
    SAMPLE,
    SUMMARY_SCHEMA,
    TODO,
    CopyPolicy,
    TableSpec,
    UnresolvedRequest,
)
from sluice.operators import changes, compaction, copy, lease, ledger, register, sample, select
from sluice.operators.hooks import AfterCopy, BeforeSample, CopyContext
from sluice.session import local_rows, pin
from sluice.sources import files, footers
from sluice.sources.tables import (
    SourceTable,
    catalog_partitions,
    list_partitions,
    located_partitions,
    logical_bytes,
    open_folder,
    size_by_partition,
)

logger = logging.getLogger(__name__)

# Marks a whole copy and says what it was made by; scans skip names that start with an underscore.
COMPLETE = "_copied"


@dataclass(frozen=True)
class RunTarget:
    """Where a run puts its copies, and under which database they are registered.

    Without a database each table keeps that of its source.
    """

    folder: str
    database: str | None = None
    ledger: str | None = None
    log: str | None = None

    def database_of(self, name: str) -> str:
        return self.database or name.rpartition(".")[0].rpartition(".")[2] or "default"

    def table_of(self, name: str) -> str:
        """The name under which the copy is registered."""
        return f"{self.database_of(name)}.{name.rpartition('.')[2]}"

    def table_path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{self.table_of(name).replace('.', '/')}"

    @property
    def leases(self) -> str:
        """Where runs hold the copies they work on; a hidden name that no listing shows."""
        return f"{self.folder.rstrip('/')}/_leases"


@dataclass
class RunResult:
    """What a run did."""

    tables: dict[str, SourceTable] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    ledger_rows: list[tuple] = field(default_factory=list)
    #: Per table that was copied again: ``name, change`` of its partitions since then.
    changes: dict[str, DataFrame] = field(default_factory=dict)

    def report(self, spark: SparkSession) -> DataFrame:
        return ledger.report(local_rows(spark, self.ledger_rows, LEDGER_SCHEMA))


def _resolve(spark: SparkSession, table: SourceTable, spec: TableSpec, policy: CopyPolicy):
    """Chosen partitions (pinned; None for a plain table) and the bytes they hold.

    Partitions are chosen before anything is sized. A laid-out table is sized by its
    listing; for any other, only rows of the chosen partitions are measured.
    """
    columns = list(table.partition_columns)
    if not columns:
        return None, _total(size_by_partition(spark, table))
    by_footer = policy.footer_sizes and table.location is None and table.layout is not None
    sized = table.location is not None or by_footer
    if by_footer:
        listed = footers.partition_sizes(spark, table)
    elif not sized:
        listed = list_partitions(table)
    elif table.registered:
        listed = catalog_partitions(spark, table.name)
    else:
        listed = located_partitions(spark, table)
    chosen = pin(
        select.resolve(
            listed, spec.partitions, policy.partition_count(spec), spec.top_level_count or -1
        ),
        "chosen",
    )
    if sized and table.registered:
        chosen = pin(located_partitions(spark, table, chosen), "located")
    if sized:
        return chosen, _total(chosen)
    rows = replace(table, frame=select.rows_of(table.frame, chosen, columns, table.layout))
    return chosen, _total(size_by_partition(spark, rows))


def _total(sized: DataFrame) -> int:
    return sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long")).first()[0]


def copy_tables(
    spark: SparkSession,
    sources: Mapping[str, SourceTable],
    specs: Sequence[TableSpec],
    target: RunTarget,
    policy: CopyPolicy = CopyPolicy(),
    before_sample: Sequence[BeforeSample] = (),
    after_copy: Sequence[AfterCopy] = (),
    loose_files: Sequence[str] = (),
) -> RunResult:
    """Copy the requested tables and loose files; one table's failure does not stop others.

    ``sources`` maps a requested name to its table; a name that is missing is invalid.
    With a ledger, finished and invalid items are not tried again, failed ones are. A copy that
    another run works on is an error without an entry in the ledger, and a run that another one
    has overtaken (it was silent for ``lease_seconds``) publishes nothing more.
    """
    with lease.Leases(spark, target.leases, policy.lease_seconds) as leases:
        result = _copy_held(spark, sources, specs, target, policy, before_sample, after_copy, loose_files, leases)
    for path, compact in ((target.ledger, ledger.compact), (target.log, register.compact_log)):
        try:
            if path is not None and compaction.tail_length(spark, path) > policy.compact_after:
                compact(spark, path)
        except Exception:  # the next run tries again
            logger.exception("cannot compact %s", path)
    return result


def _copy_held(
    spark, sources, specs, target, policy, before_sample, after_copy, loose_files, leases: lease.Leases
) -> RunResult:
    if not specs and not loose_files:
        raise ValueError("no source tables or files configured")
    result = RunResult()
    by_name = {spec.name: spec for spec in specs}
    if len(by_name) < len(specs):
        raise ValueError("two requests for one table: put their specs into one")
    owners: dict[str, str] = {}
    for name in by_name:
        other = owners.setdefault(target.table_path(name).lower(), name)
        if other != name:
            raise ValueError(f"{other} and {name} would be one copy: keep their databases or name folders of their own")

    def note(*states: tuple[str, str, float, str | None]) -> None:
        moment = ledger.now()
        rows = [(item, state, moment, int(seconds), text, leases.token(item)) for item, state, seconds, text in states]
        result.ledger_rows.extend(rows)
        if target.ledger is not None and rows:
            try:
                ledger.record(spark, target.ledger, rows)
            except Exception:  # the copy itself goes on
                logger.exception("cannot write the ledger entry of %s", [row[0] for row in rows])

    def side_by_side(work: Callable[[str], object], names: Sequence[str]) -> list:
        """Run once per table, a few tables at a time, each in a scheduler pool of its own."""

        def pooled(name: str) -> object:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            return work(name)

        with ThreadPoolExecutor(max(1, policy.table_parallelism)) as pool:
            return list(pool.map(inheritable_thread_target(spark)(pooled), names))

    def take(name: str) -> str | None:
        try:
            leases.take(name, target.table_of(name))
        except lease.LeaseHeld as error:
            return f"{type(error).__name__}: {error}"
        return None

    # Before the ledger is read: what another run finished until now is in it.
    result.errors.update({n: e for n, e in zip(by_name, side_by_side(take, list(by_name))) if e})
    attempt = set(by_name) - set(result.errors)
    if target.ledger is not None and by_name:
        configured = local_rows(spark, [(name,) for name in by_name], "item string")
        run = ledger.next_run(configured, ledger.open_ledger(spark, target.ledger))
        attempt &= {row["item"] for row in ledger.attempts(run).collect()}
    for name in set(by_name) - attempt:
        leases.drop(name)

    def resolve_one(name: str):
        try:
            if name not in sources:
                raise UnresolvedRequest(f"table not found: {name}")
            return _resolve(spark, sources[name], by_name[name], policy)
        except UnresolvedRequest as error:
            return error
        except Exception as error:  # a table that cannot be read is invalid, the run goes on
            return UnresolvedRequest(f"{type(error).__name__}: {error}")

    names = [name for name in by_name if name in attempt]
    outcomes = dict(zip(names, side_by_side(resolve_one, names)))
    invalid = {n: str(o) for n, o in outcomes.items() if isinstance(o, UnresolvedRequest)}
    result.errors.update(invalid)
    resolved = {n: o[0] for n, o in outcomes.items() if n not in invalid}
    sizes = [(n, outcomes[n][1], None, None, None) for n in resolved]
    note(
        *[(n, INVALID, 0, text) for n, text in invalid.items()],
        *[(n, TODO, 0, None) for n in resolved],
    )

    summary = local_rows(spark, sizes, SUMMARY_SCHEMA)
    requests = sample.requests_frame(spark, [by_name[name] for name in resolved])
    decisions = {row["name"]: row for row in sample.resolve_policy(summary, requests, policy).collect()}

    def copy_one(name: str) -> None:
        started = time.monotonic()
        # From here on the table goes by its requested name.
        table = replace(sources[name], name=name, registered=False)
        chosen, decision = resolved[name], decisions[name]
        path = target.table_path(name)
        try:
            done, changed, anew = _copy_table(
                spark, table, path, chosen, decision, policy, before_sample, target, lambda: leases.check(name)
            )
            if changed is not None:
                result.changes[name] = changed
            context = CopyContext(spark, table, done, decision["mode"])
            for hook in after_copy:
                hook(context)
            moved = policy.byte_copy and table.location is not None
            if chosen is not None and not moved:
                # Folders of written rows are named after the typed values.
                chosen = chosen.withColumn("name", paths.partition_name(table.partition_columns))
            leases.check(name)
            _register(spark, table, done, chosen, decision["mode"], target, anew)
        except Exception as error:  # a table's failure is recorded, the run goes on
            result.errors[name] = f"{type(error).__name__}: {error}"
            note((name, FAILED, time.monotonic() - started, str(error)))
            return
        result.tables[name], result.modes[name] = done, decision["mode"]
        note((name, FINISHED, time.monotonic() - started, _kept_text(result.changes.get(name), policy)))
        leases.drop(name)

    side_by_side(copy_one, list(resolved))
    for source in loose_files:
        started = time.monotonic()
        try:
            copy_loose(spark, source, target, policy.overwrite_if_exists)
        except Exception as error:  # the tables are done; what is missing is recorded
            result.errors[source] = f"{type(error).__name__}: {error}"
            note((source, FAILED, time.monotonic() - started, str(error)))
    return result


def _kept_text(changed: DataFrame | None, policy: CopyPolicy) -> str | None:
    """What the ledger says of partitions that changed and stayed as they are."""
    if changed is None or policy.overwrite_if_exists:
        return None
    count = changed.where(F.col("change") == changes.CHANGED).count()
    return f"{count} partitions changed at the source and stay as overwriting is off" if count else None


def _request(table: SourceTable, decision, policy: CopyPolicy, before_sample: Sequence[BeforeSample] = ()) -> dict:
    """What makes the rows of a copy: two runs with another one do not mix.

    Hooks are a part of it, as they change the rows of a sample. A sample without key columns takes all columns with comparable text as the key, so it
    too is the same in every run; ``rand`` is taken only when asked for.
    """
    if decision["mode"] == FULL:
        return {"mode": FULL, "p": 1.0, "keys": [], "method": "", "hooks": []}
    keys = list(policy.sample_keys.get(table.name, ()))
    if not keys and policy.sample_method != "rand":
        keys = [f.name for f in table.frame.schema if isinstance(f.dataType, T.AtomicType)]
    return {
        "mode": SAMPLE,
        "p": decision["probability"],
        "keys": keys,
        "method": policy.sample_method,
        "hooks": [changes.identity(hook) for hook in before_sample],
    }


def _earlier_request(spark, marker: str) -> tuple[dict | None, str | None]:
    """The request a copy was made by, and the fingerprint of the files it was made from."""
    text = storage.read_text(spark, marker)
    noted = json.loads(text) if text else None
    return noted, noted.pop("source", None) if noted else None


def _copy_table(spark, table, path, chosen, decision, policy, before_sample, target, check):
    """Make, replace or complete the copy of one table.

    A repeated run brings new partitions, and puts those that changed at the source in place of
    the old ones if overwriting is on; others are not touched. One with another mode,
    probability, key, method or hook replaces the copy if overwriting is on, and is an error
    otherwise. ``check`` fails if another run has taken over and is asked before anything becomes
    visible. Returns the copy, what changed since the last run, and whether all of it is new.
    """
    request = _request(table, decision, policy, before_sample)
    columns = list(table.partition_columns)
    moved = decision["mode"] == FULL and policy.byte_copy and table.location is not None
    hooks = before_sample if decision["mode"] == SAMPLE else ()

    def write(to: str, wanted: DataFrame | None) -> None:
        if moved:
            copy.full_copy_bytes(spark, table, to, wanted)
        elif decision["mode"] == FULL:
            copy.full_copy(spark, table, to, wanted)
        else:
            copy.sample_copy(
                spark, table, to, request["p"], request["keys"], wanted, request["method"], before_sample=hooks
            )

    def mark(to: str, read: str | None) -> None:
        storage.write_text(spark, f"{to}/{COMPLETE}", json.dumps(request | {"source": read}))

    # Taken before anything is copied: what changes meanwhile counts as changed.
    read = changes.source_files(table.frame) if table.location is None and columns else None

    def publish(to: str) -> None:
        write(to, chosen)
        if chosen is not None:
            copy.record_partitions(spark, to, chosen)
        mark(to, read)
        # The last step before the folder is moved into place.
        check()

    marker = f"{path}/{COMPLETE}"
    done = storage.exists(spark, marker)
    earlier, was = _earlier_request(spark, marker) if done else (None, None)
    same = done and earlier == request
    if done and not same and policy.same_request_only:
        raise ValueError(f"{path} holds a copy by another request")
    if done and not same and not policy.overwrite_if_exists:
        raise ValueError(f"{path} holds a copy by another request; it stays as overwriting is off")
    found = None
    if same and columns:
        register.check_definition(spark, target.table_of(table.name), table.frame.schema, columns)
        found = _changes(spark, table, path, chosen, request, hooks, read is not None and read == was)
        new = _only(chosen, found, changes.ADDED)
        if not new.isEmpty():
            check()
            if moved:
                write(path, new)
                copy.record_partitions(spark, path, new)
            else:
                copy.incremental_copy(
                    spark, table, path, new, request["p"], request["keys"], request["method"] or "md5", hooks
                )
        old = _only(chosen, found, changes.CHANGED)
        if policy.overwrite_if_exists and not old.isEmpty():
            typed = old if moved else old.withColumn("name", paths.partition_name(columns))
            into = pin(typed, "changed")
            check()
            copy.replace_partitions(
                spark, path, into, lambda some, to: _rewrite(spark, table, to, some, moved, request, hooks)
            )
            copy.record_partitions(spark, path, old)
        if policy.overwrite_if_exists or not found.where(F.col("change") == changes.CHANGED).count():
            check()
            mark(path, read)
    elif policy.overwrite_if_exists or not done:
        if storage.renames_in_place(spark, path):
            copy.staged_publish(spark, publish, path, overwrite=True)
        else:
            # Moving the folder would copy it a second time. Without its marker a broken
            # copy is not taken for a whole one, and the next run starts it again.
            check()
            storage.remove(spark, path)
            publish(path)
    copied = open_folder(spark, table.name, path, table.frame.schema, table.partition_columns, table.storage)
    return copied, found, not same


def _only(chosen: DataFrame, found: DataFrame, change: str) -> DataFrame:
    """The chosen partitions with a change, pinned."""
    return pin(chosen.join(found.where(F.col("change") == change).select("name"), "name", "left_semi"), change)


def _rewrite(spark, table, to: str, some: DataFrame, moved: bool, request: dict, hooks) -> None:
    """Rows or files of some partitions, laid out below a folder that may hold others."""
    if moved:
        copy.full_copy_bytes(spark, table, to, some)
        return
    rows = copy.copied_rows(table, request["p"], request["keys"], request["method"], some, hooks)
    cluster = table.location is None or request["p"] < 1
    copy.write_partitioned(rows, to, table.partition_columns, "append", cluster, table.storage)


def _changes(spark, table, path, chosen, request, hooks, unread: bool) -> DataFrame:
    """``name, change`` of the chosen partitions and those of the copy, pinned.

    Laid-out partitions are told by their files. Of other tables the rows are compared, unless no
    file of them has changed, or the sample would not be the same twice.
    """
    taken = copy.recorded_partitions(spark, path)
    if table.location is not None:
        return pin(changes.partition_changes(chosen, taken), "changes")
    columns = list(table.partition_columns)
    here = chosen.select("name", F.lit("").alias("fingerprint"))
    found = changes.partition_changes(here, taken.select("name", F.lit("").alias("fingerprint")))
    if unread or request["method"] == "rand":
        return pin(found, "changes")
    both = pin(chosen.join(taken.select("name"), "name", "left_semi"), "in-both")
    source = copy.copied_rows(table, request["p"], request["keys"], request["method"], both, hooks)
    copied = open_folder(spark, table.name, path, table.frame.schema, table.partition_columns, table.storage)
    copied = select.rows_of(copied.frame, both, columns)
    other = pin(changes.changed_rows(source, copied, columns), "changed-rows")
    # Names of the request may be spelled otherwise than those of typed values.
    typed = both.select("name", paths.partition_name(columns).alias("typed"))
    changed = typed.join(other.withColumnRenamed("name", "typed"), "typed", "left_semi")
    return pin(found.union(changed.select("name", F.lit(changes.CHANGED).alias("change"))), "changes")


def _register(spark, table, done, chosen, mode, target: RunTarget, anew: bool = True) -> None:
    columns = list(table.partition_columns)
    database, _, short = target.table_of(table.name).partition(".")
    name = f"{database}.{short}"
    schema = table.frame.schema
    register.create_database(spark, database)
    # A whole copy registers every chosen partition, empty ones too; a sample what it has.
    whole = bool(columns) and mode == FULL
    definition = {"comment": table.comment, "properties": table.properties}
    known = None
    if columns and not anew and spark.catalog.tableExists(quoted_name(name)):
        known = pin(catalog_partitions(spark, name), "known-partitions")
    adapted = register.adapt_definition(spark, name, schema, columns, anew)
    register.register_copy(spark, name, schema, columns, done.location, table.storage, not whole, **definition)
    again = known is not None and register.DROPPED in adapted
    if again:
        register.add_partitions(spark, name, known, columns, done.location)
    if whole:
        register.add_partitions(spark, name, chosen, columns, done.location)
    if columns:
        # Files of a known partition may have been replaced.
        spark.catalog.refreshTable(quoted_name(name))
    if target.log is not None:
        nothing = local_rows(spark, [], "name string")
        logged = copied_partitions(spark, done, chosen, mode) if columns else nothing
        if again:
            logged = logged.union(known.select("name")).distinct()
        location = F.concat(F.lit(f"/{database}/{short}/"), F.col("name"))
        statements = register.table_statements(
            logged, database, short, schema, columns, location, table.storage, **definition, adapted=adapted
        )
        register.append_log(statements, target.log)


def copied_partitions(spark, done: SourceTable, chosen: DataFrame, mode: str) -> DataFrame:
    """Partitions a copy has: all chosen ones after a whole copy, the folders after a sample."""
    if mode == FULL:
        return chosen.select("name")
    folders = files.partition_folders(files.list_files(spark, done.location))
    return folders.where(F.col("name") != "").select("name").distinct()


def copy_loose(spark: SparkSession, source: str, target: RunTarget, overwrite: bool) -> DataFrame:
    """Copy one loose file or folder below the target's folder, keeping its relative path."""
    relative = storage.path_of(spark, source).strip("/")
    place = f"{target.folder.rstrip('/')}/{relative}"
    if storage.is_file(spark, source):
        place = place.rpartition("/")[0]
    report = copy.whole(copy.copy_files(spark, source, place, overwrite=overwrite), source)
    if target.log is not None:
        base = storage.qualify(spark, target.folder)
        listing = report.select(paths.path_below(F.col("target"), base).alias("relative"))
        register.append_log(register.file_statements(listing, base), target.log, register.FILES)
    return report


def copy_and_attach(
    spark: SparkSession, shared: str, local: str, log: str = "copy-log", database: str | None = None
) -> int:
    """Copy what others left below ``shared`` to ``local`` and register it from there.

    Everything but the log is copied byte for byte; the log's statements then run with the
    local folder as their base. Returns how many statements ran.
    """
    listing = files.walk_files(spark, shared).where(F.substring_index("relative", "/", 1) != log)
    copy.whole(copy.copy_listed(spark, listing, local), shared)
    return register.attach(
        spark, register.read_log(spark, f"{shared.rstrip('/')}/{log}"), storage.qualify(spark, local), database
    )


def selected_bytes(table: SourceTable, specs) -> int:
    """Row-width size of the rows that specs select, for a size-target sample."""
    data = table.frame.select(*[c for c in table.frame.columns if c not in table.partition_columns]).schema
    rows = select.rows_of_specs(table, specs)
    return rows.agg(F.coalesce(F.sum(logical_bytes(data)), F.lit(0)).cast("long")).first()[0]
