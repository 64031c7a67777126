import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from sluice.session import build_session, drop_scratch

    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture
def monthly(spark):
    """Months 1-3 x days 1-2 with rows a and b in each, laid out by month and day."""
    return lay_out(spark, [(n, m, d) for m in (1, 2, 3) for d in (1, 2) for n in "ab"])


def lay_out(spark, rows, schema="name string, month int, day int", name="lake.monthly"):
    from sluice.operators.copy import write_partitioned
    from sluice.session import new_scratch
    from sluice.sources.tables import open_folder

    frame = spark.createDataFrame(rows, schema)
    path = new_scratch(spark, "fixture")
    write_partitioned(frame, path, ["month", "day"])
    return open_folder(spark, name, path, frame.schema, ("month", "day"))


def names(frame):
    return sorted(row["name"] for row in frame.collect())
