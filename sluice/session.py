"""Session settings, scratch folders and pinned tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "sluice", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Splits a hot output partition of a clustered write over several tasks.
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Tables of a run are copied side by side.
        "spark.scheduler.mode": "FAIR",
        # Output files of a clustered write; rows of a hot partition split at this size.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        # Keeps some partition writers open instead of sorting each task's rows.
        "spark.sql.maxConcurrentOutputFileWriters": "64",
        **extra,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own;
    on a cluster a machine-local folder would not be visible to the executors.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="sluice-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


_HANDED_OUT: list[str] = []


def new_scratch(spark: SparkSession, label: str) -> str:
    """Path of a fresh folder (not created yet) below the scratch root."""
    path = f"{scratch_root(spark)}/sluice-{label}-{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete all scratch folders this process has handed out; frames over them end."""
    from sluice import storage

    folders = list(_HANDED_OUT)
    _HANDED_OUT.clear()
    return storage.remove_all(spark, folders)


def handed_out() -> list[str]:
    """All scratch folders of this process that were not dropped, the oldest first."""
    return list(_HANDED_OUT)


def drop_folders(spark: SparkSession, folders: list[str]) -> int:
    """Delete some of them, when nothing reads them any more."""
    from sluice import storage

    gone = set(folders)
    _HANDED_OUT[:] = [f for f in _HANDED_OUT if f not in gone]
    return storage.remove_all(spark, folders)


def pin(df: DataFrame, label: str = "pin") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst the measured size,
    so that it broadcasts the result only below ``autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A frame of request-sized rows whose size Catalyst knows.

    Rows that come as an Arrow table become a local relation, which the optimizer
    sizes; rows that come as Python objects would be of unknown size.
    """
    frame = spark.createDataFrame([], schema)
    names = frame.columns
    if not rows:
        return frame
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = pa.Table.from_pylist(
        [dict(zip(names, row)) for row in rows], schema=to_arrow_schema(frame.schema)
    )
    return spark.createDataFrame(arrow, frame.schema)
