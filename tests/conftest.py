import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("rowtrail-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.default.parallelism", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Literal rows with an explicit row number column ``n`` = position."""

    def make(schema, *values):
        numbered = [(i, *v) for i, v in enumerate(values)]
        return spark.createDataFrame(numbered, f"n bigint, {schema}")

    return make


@pytest.fixture
def source(rows):
    """A tracked literal table whose row ids are the positions."""

    def make(trail, name, schema, *values):
        return trail.source(rows(schema, *values), name, row_key="n").drop("n")

    return make


@pytest.fixture
def tokens():
    """{row values of ``keys``: set of tokens} of a tracked frame, through consolidate and decode."""
    from rowtrail.operators import lineage

    def read(t, *keys):
        out = {}
        for row in lineage.decoded(t).collect():
            key = row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys)
            out.setdefault(key, set()).update(row["_prov"])
        return out

    return read
