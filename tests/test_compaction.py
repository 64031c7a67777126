"""Snapshots of the ledger and the log, with what is appended after them."""

import shutil
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest

from sluice import storage
from sluice.operators import compaction, lease, ledger, register
from sluice.session import local_rows, new_scratch

START = datetime(2024, 1, 1)


def note(spark, path, n, state, item=None):
    ledger.record(spark, path, [(item or f"t{n}", state, START + timedelta(seconds=n), n, None)])


def states(spark, path):
    return {r["item"]: (r["state"], r["seconds"]) for r in ledger.latest(ledger.open_ledger(spark, path)).collect()}


@pytest.fixture
def path(spark):
    place = new_scratch(spark, "ledger")
    for n in range(4):
        note(spark, place, n, "todo")
    note(spark, place, 9, "finished", "t1")
    return place


def test_states_stay_and_few_files_are_left(spark, path):
    base = storage.path_of(spark, path)
    one = storage.child_names(spark, path)[0]
    for n in range(1000):
        shutil.copytree(f"{base}/{one}", f"{base}/entry-copy-{n}")
    before = states(spark, path)
    assert ledger.compact(spark, path, grace=0) == 1005
    assert states(spark, path) == before == {"t0": ("todo", 0), "t1": ("finished", 9), "t2": ("todo", 2), "t3": ("todo", 3)}
    assert len(ledger.open_ledger(spark, path).inputFiles()) < 20
    assert storage.child_names(spark, path) == []
    assert ledger.compact(spark, path, grace=0) == 0
    note(spark, path, 20, "failed", "t0")
    assert states(spark, path) == before | {"t0": ("failed", 20)}
    assert ledger.compact(spark, path, grace=0) == 1
    assert states(spark, path) == before | {"t0": ("failed", 20)}
    assert len(compaction.places(spark, path)) == 1


def test_old_folders_stay_for_the_grace_time(spark, path):
    opened = ledger.open_ledger(spark, path)
    ledger.compact(spark, path)
    assert len(storage.child_names(spark, path)) == 5
    assert opened.count() == 5 and ledger.open_ledger(spark, path).count() == 4
    note(spark, path, 20, "failed", "t0")
    ledger.compact(spark, path)
    assert len(storage.child_names(spark, path)) == 6
    assert ledger.open_ledger(spark, path).count() == 4 and states(spark, path)["t0"] == ("failed", 20)


def test_crash_before_the_switch_changes_nothing(spark, path, monkeypatch):
    before = states(spark, path)
    create = storage.create_text

    def crash(spark, place, text):
        if "/_current/" in place:
            raise OSError("died")
        return create(spark, place, text)

    monkeypatch.setattr(storage, "create_text", crash)
    with pytest.raises(OSError, match="died"):
        ledger.compact(spark, path, grace=0)
    monkeypatch.setattr(storage, "create_text", create)
    assert states(spark, path) == before and compaction.places(spark, path) == [path]
    # A pointer that was not written to its end does not count either.
    storage.make_dir(spark, f"{path}/_current")
    storage.write_text(spark, f"{path}/_current/{1:012d}", '{"snapshot": "x", "cov')
    assert states(spark, path) == before
    assert ledger.compact(spark, path, grace=0) == 5
    assert states(spark, path) == before
    assert len(storage.child_times(spark, f"{path}/_snapshots")) == 1


def test_unfinished_entries_stay_in_the_tail(spark, path):
    note(spark, path, 30, "failed", "t2")
    base = storage.path_of(spark, path)
    late = next(n for n in storage.child_names(spark, path) if "failed" in str(spark.read.parquet(f"{path}/{n}").collect()))
    shutil.move(f"{base}/{late}/_SUCCESS", f"{base}/_mark")
    assert ledger.compact(spark, path, grace=0) == 5
    assert storage.child_names(spark, path) == [late]
    assert states(spark, path)["t2"] == ("failed", 30)


def test_one_compaction_at_a_time_and_writers_meanwhile(spark, path):
    held = lease.acquire(spark, f"{path}/_lease", 60)
    with pytest.raises(lease.LeaseHeld):
        ledger.compact(spark, path)
    held.release()
    with ThreadPoolExecutor(6) as pool:
        writes = [pool.submit(note, spark, path, 100 + i, "finished") for i in range(12)]
        pool.submit(ledger.compact, spark, path, 0).result()
        [w.result() for w in writes]
    found = states(spark, path)
    assert len(found) == 16 and all(found[f"t{100 + i}"] == ("finished", 100 + i) for i in range(12))
    ledger.compact(spark, path, grace=0)
    assert states(spark, path) == found


def test_log_keeps_every_statement_and_its_order(spark):
    log = new_scratch(spark, "log")
    for n in range(6):
        listing = local_rows(spark, [(f"f{n}",), (f"g{n}",)], "relative string")
        register.append_log(register.file_statements(listing, "s3a://shared"), log)
    before = [tuple(r) for r in register.describe_log(register.read_log(spark, log)).collect()]
    assert register.compact_log(spark, log, grace=0) == 6
    assert [tuple(r) for r in register.describe_log(register.read_log(spark, log)).collect()] == before
    listing = local_rows(spark, [("last",)], "relative string")
    register.append_log(register.file_statements(listing, "s3a://shared"), log)
    assert register.read_log(spark, log).count() == 13


def test_nothing_there(spark):
    place = new_scratch(spark, "none")
    assert ledger.compact(spark, place) == 0 and compaction.tail_length(spark, place) == 0
