"""Folder operations on any Hadoop file system, run from the driver (metadata only)."""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jpath


def qualify(spark: SparkSession, path: str) -> str:
    """The path as listings show it, with scheme and authority, without trailing slash."""
    fs, jpath = _resolve(spark, path)
    return fs.makeQualified(jpath).toString().rstrip("/")


def path_of(spark: SparkSession, path: str) -> str:
    """The path alone, without scheme, host and port."""
    fs, jpath = _resolve(spark, path)
    return fs.makeQualified(jpath).toUri().getPath()


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _resolve(spark, path)
    return fs.exists(jpath)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, jpath = _resolve(spark, path)
    return fs.exists(jpath) and fs.getFileStatus(jpath).isFile()


def make_dir(spark: SparkSession, path: str) -> None:
    fs, jpath = _resolve(spark, path)
    fs.mkdirs(jpath)


def remove(spark: SparkSession, path: str) -> bool:
    fs, jpath = _resolve(spark, path)
    return fs.delete(jpath, True)


def remove_all(spark: SparkSession, paths: Iterable[str], threads: int = 16) -> int:
    """Delete folders concurrently; returns how many were there."""
    with ThreadPoolExecutor(threads) as pool:
        return sum(pool.map(lambda p: remove(spark, p), paths))


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, jsource = _resolve(spark, source)
    jtarget = spark._jvm.org.apache.hadoop.fs.Path(target)
    parent = jtarget.getParent()
    if parent is not None:
        fs.mkdirs(parent)
    if not fs.rename(jsource, jtarget):
        raise OSError(f"cannot rename {source} to {target}")


# Stores where renaming a folder copies every object in it.
_COPYING_RENAME = ("s3", "s3a", "s3n", "gs", "oss", "cosn", "wasb", "wasbs", "swift")


def renames_in_place(spark: SparkSession, path: str) -> bool:
    """Whether moving a folder costs the same whatever it holds."""
    return qualify(spark, path).split(":", 1)[0] not in _COPYING_RENAME


def existing(spark: SparkSession, paths: Iterable[str], threads: int = 16) -> list[str]:
    """Those of the paths that exist, asked for concurrently."""
    paths = list(paths)
    with ThreadPoolExecutor(threads) as pool:
        return [p for p, there in zip(paths, pool.map(lambda p: exists(spark, p), paths)) if there]


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; 0 if there is nothing."""
    fs, jpath = _resolve(spark, path)
    return fs.getContentSummary(jpath).getLength() if fs.exists(jpath) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, jpath = _resolve(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file only if there is none; whether it was written.

    Hadoop's local file system looks first and then writes, so there the operating system's
    exclusive creation is used.
    """
    data = text.encode("utf-8")
    if qualify(spark, path).startswith("file:"):
        try:
            with open(path_of(spark, path), "xb") as out:
                out.write(data)
        except FileExistsError:
            return False
        return True
    fs, jpath = _resolve(spark, path)
    try:
        stream = fs.create(jpath, False)
    except Py4JJavaError:
        if fs.exists(jpath):
            return False
        raise
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _resolve(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def set_age(spark: SparkSession, path: str, millis: int) -> None:
    """Date a file back from now."""
    fs, jpath = _resolve(spark, path)
    fs.setTimes(jpath, int(time.time() * 1000) - millis, -1)


def child_times(spark: SparkSession, path: str) -> dict[str, int]:
    """Names directly below a folder with their times in milliseconds; hidden ones left out."""
    fs, jpath = _resolve(spark, path)
    found = {status.getPath().getName(): status.getModificationTime() for status in fs.listStatus(jpath)}
    return {n: t for n, t in found.items() if not n.startswith(("_", "."))}


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, hidden ones left out."""
    fs, jpath = _resolve(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(jpath)]
    return sorted(n for n in names if not n.startswith(("_", ".")))
