"""Leases with growing tokens: of several runs on one copy, one works and the others are refused.

A lease is a folder with a file per token, and the highest token is that of the holder. A token file
is created only if it is absent, so of two runs that want the same one a single run gets it. The
holder renews its lease by a beat file beside it; without a beat for the lease's seconds another
run may take the next token, and what the old holder then wants to publish is refused
(``Lease.check``). Tokens are in the ledger too, where a later token's states win.

Ages are told by the file system's own times, so drivers' clocks do not matter. A check first beats
and then looks for a higher token; a run that takes a token looks once more for a beat after that,
and steps back if there is one. So after a check the holder has the lease's seconds to
publish. On object stores without conditional creation two runs may create one token; each reads
the file back, and the one that finds the other's name steps back.
"""

from __future__ import annotations

import json
import logging
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from sluice import storage

logger = logging.getLogger(__name__)

_BEAT, _DONE, _WISH = "-beat", "-done", "wish-"


class LeaseHeld(RuntimeError):
    """Another run works on the copy."""


class LeaseLost(RuntimeError):
    """Another run has taken over; nothing may be published any more."""


def _tokens(seen: dict[str, int]) -> list[int]:
    return sorted(int(name) for name in seen if name.isdigit())


def _name(token: int) -> str:
    return f"{token:012d}"


def _live(spark: SparkSession, folder: str, token: int, seen: dict[str, int], now: int) -> bool:
    """Whether the holder of a token neither released it nor fell silent."""
    name = _name(token)
    if f"{name}{_DONE}" in seen:
        return False
    try:
        seconds = json.loads(storage.read_text(spark, f"{folder}/{name}"))["seconds"]
    except Exception:  # being written, or removed by a run that stepped back
        return name in storage.child_times(spark, folder)
    last = max(seen.get(name, 0), seen.get(f"{name}{_BEAT}", 0))
    return now - last < seconds * 1000


@dataclass(frozen=True)
class Lease:
    spark: SparkSession
    folder: str
    token: int
    holder: str

    def _path(self, kind: str = "") -> str:
        return f"{self.folder}/{_name(self.token)}{kind}"

    def check(self) -> None:
        """Renew the lease; an error if a later token is there."""
        storage.write_text(self.spark, self._path(_BEAT), self.holder)
        tokens = _tokens(storage.child_times(self.spark, self.folder))
        if not tokens or tokens[-1] != self.token:
            raise LeaseLost(f"token {self.token} of {self.folder} is no longer the last one")

    def release(self) -> None:
        storage.write_text(self.spark, self._path(_DONE), self.holder)


def acquire(spark: SparkSession, folder: str, seconds: float) -> Lease:
    """The next token, or ``LeaseHeld``. Files of earlier tokens are removed."""
    holder = uuid.uuid4().hex
    storage.make_dir(spark, folder)
    wish = f"{folder}/{_WISH}{holder}"
    storage.write_text(spark, wish, holder)
    try:
        seen = storage.child_times(spark, folder)
    finally:
        storage.remove(spark, wish)
    last = max(_tokens(seen), default=0)
    if last and _live(spark, folder, last, seen, seen[f"{_WISH}{holder}"]):
        raise LeaseHeld(f"{folder} is held by another run")
    lease = Lease(spark, folder, last + 1, holder)
    own = json.dumps({"holder": holder, "seconds": seconds})
    if not storage.create_text(spark, lease._path(), own):
        raise LeaseHeld(f"{folder} was just taken by another run")
    seen = storage.child_times(spark, folder)
    now = seen.get(_name(lease.token), 0)
    if storage.read_text(spark, lease._path()) != own:
        raise LeaseHeld(f"{folder} was just taken by another run")
    if _tokens(seen)[-1] > lease.token or (last in _tokens(seen) and _live(spark, folder, last, seen, now)):
        storage.remove(spark, lease._path())
        raise LeaseHeld(f"{folder} is held by another run")
    older = [name for name in seen if name[:12].isdigit() and int(name[:12]) < lease.token]
    storage.remove_all(spark, [f"{folder}/{name}" for name in older])
    return lease


class Leases:
    """The leases of a run by name, renewed until the run ends."""

    def __init__(self, spark: SparkSession, root: str, seconds: float):
        self.spark, self.root, self.seconds = spark, root.rstrip("/"), seconds
        self._held: dict[str, Lease] = {}
        self._lock, self._ended = threading.Lock(), threading.Event()

    def __enter__(self) -> Leases:
        self._thread = threading.Thread(target=self._renew, name="leases", daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._ended.set()
        self._thread.join()
        for name in list(self._held):
            self.drop(name)

    def take(self, name: str, place: str) -> None:
        """Hold ``place`` below the root for ``name``."""
        lease = acquire(self.spark, f"{self.root}/{place}", self.seconds)
        with self._lock:
            self._held[name] = lease

    def drop(self, name: str) -> None:
        with self._lock:
            lease = self._held.pop(name, None)
        if lease is not None:
            try:
                lease.release()
            except Exception:  # it runs out by itself
                logger.exception("cannot release %s", lease.folder)

    def token(self, name: str) -> int | None:
        lease = self._held.get(name)
        return lease.token if lease else None

    def check(self, name: str) -> None:
        lease = self._held.get(name)
        if lease is None:
            raise LeaseLost(f"no lease for {name}")
        lease.check()

    def _renew(self) -> None:
        while not self._ended.wait(self.seconds / 3):
            with self._lock:
                held = list(self._held.values())
            for lease in held:
                try:
                    lease.check()
                except LeaseLost as error:
                    logger.warning("%s", error)
                except Exception:  # tried again at the next beat
                    logger.exception("cannot renew %s", lease.folder)
