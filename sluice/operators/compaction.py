"""Tables of many small appended folders, read as a snapshot and a tail.

``compact`` writes what all finished appends say as a snapshot, and then a pointer that names the
snapshot and the appends it covers. Readers take the last pointer, its snapshot and whatever it does
not cover. Before the pointer is there the snapshot does not count, so a crash in between
changes nothing, and appends that end meanwhile stay in the tail. Covered folders, earlier
snapshots and pointers are deleted ``grace`` seconds later, by the next compaction, as
frames that were opened before still read them. A lease lets one compaction work at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sluice import storage
from sluice.operators import lease

GRACE_SECONDS = 3600

_POINTERS, _SNAPSHOTS, _LEASE = "_current", "_snapshots", "_lease"
_LEASE_SECONDS = 300


@dataclass(frozen=True)
class _Current:
    number: int = 0
    snapshot: str = ""
    covers: frozenset[str] = frozenset()
    millis: int = 0


def _times(spark: SparkSession, folder: str) -> dict[str, int]:
    return storage.child_times(spark, folder) if storage.exists(spark, folder) else {}


def _current(spark: SparkSession, path: str) -> _Current:
    """The last pointer that is whole; one that is just being written does not count yet."""
    times = _times(spark, f"{path}/{_POINTERS}")
    for name in sorted(times, reverse=True):
        try:
            noted = json.loads(storage.read_text(spark, f"{path}/{_POINTERS}/{name}"))
        except ValueError:
            continue
        return _Current(int(name), noted["snapshot"], frozenset(noted["covers"]), times[name])
    return _Current()


def _tail(spark: SparkSession, path: str, current: _Current) -> list[str]:
    return [n for n in storage.child_names(spark, path) if n not in current.covers]


def _places(path: str, current: _Current, tail: list[str]) -> list[str]:
    start = [f"{path}/{_SNAPSHOTS}/{current.snapshot}"] if current.snapshot else []
    return start + [f"{path}/{name}" for name in tail]


def places(spark: SparkSession, path: str) -> list[str]:
    """The folders to read: all of ``path`` if it was never compacted."""
    path = path.rstrip("/")
    current = _current(spark, path)
    while True:
        tail = _tail(spark, path, current)
        # What was listed belongs to the pointer only if it is still the last one.
        before, current = current, _current(spark, path)
        if before.number == current.number:
            return _places(path, current, tail) if current.snapshot else [path]


def tail_length(spark: SparkSession, path: str) -> int:
    """Appends that no snapshot covers."""
    path = path.rstrip("/")
    return len(_tail(spark, path, _current(spark, path))) if storage.exists(spark, path) else 0


def _purge(spark: SparkSession, path: str, current: _Current, now: int, grace: float) -> None:
    """Delete what the current pointer replaces, if it has been there for the grace time."""
    if not current.snapshot or now - current.millis < grace * 1000:
        return
    there = set(storage.child_names(spark, path))
    gone = [f"{path}/{name}" for name in current.covers & there]
    snapshots = _times(spark, f"{path}/{_SNAPSHOTS}")
    gone += [f"{path}/{_SNAPSHOTS}/{name}" for name in snapshots if name != current.snapshot]
    storage.remove_all(spark, gone)
    pointers = _times(spark, f"{path}/{_POINTERS}")
    storage.remove_all(spark, [f"{path}/{_POINTERS}/{name}" for name in pointers if int(name) < current.number])


def compact(
    spark: SparkSession,
    path: str,
    read: Callable[[list[str]], DataFrame],
    shrink: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame, str], object],
    grace: float = GRACE_SECONDS,
) -> int:
    """Bring finished appends into a new snapshot; returns how many.

    ``LeaseHeld`` if another compaction works on the folder. ``shrink`` keeps what readers need.
    """
    path = path.rstrip("/")
    if not storage.exists(spark, path):
        return 0
    held = lease.acquire(spark, f"{path}/{_LEASE}", _LEASE_SECONDS)
    try:

        def now() -> int:
            held.check()
            return max(storage.child_times(spark, held.folder).values())

        before = _current(spark, path)
        _purge(spark, path, before, now(), grace)
        tail = _tail(spark, path, before)
        # An append without its mark is not finished, or failed.
        marks = storage.existing(spark, [f"{path}/{name}/_SUCCESS" for name in tail])
        done = [mark.split("/")[-2] for mark in marks]
        if not done:
            return 0
        snapshot = held.holder
        write(shrink(read(_places(path, before, done))).hint("rebalance"), f"{path}/{_SNAPSHOTS}/{snapshot}")
        held.check()
        number = max((int(n) for n in _times(spark, f"{path}/{_POINTERS}")), default=0) + 1
        storage.make_dir(spark, f"{path}/{_POINTERS}")
        still = before.covers & set(storage.child_names(spark, path))
        text = json.dumps({"snapshot": snapshot, "covers": sorted(still | set(done))})
        if not storage.create_text(spark, f"{path}/{_POINTERS}/{number:012d}", text):
            raise lease.LeaseLost(f"{path} was switched by another compaction")
        if grace <= 0:
            _purge(spark, path, _current(spark, path), now(), grace)
        return len(done)
    finally:
        held.release()
