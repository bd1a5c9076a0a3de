"""Where a job writes what later jobs read again: the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_folder: str | None = None
AT_ONCE = 4
"""Steps that do not need each other run so many at a time: most of their jobs are too short to fill a cluster."""
Found = TypeVar("Found")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for local sessions that name none."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    global _local_folder
    _local_folder = _local_folder or tempfile.mkdtemp(prefix="rowtrail-")
    return _local_folder


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back: cuts the plan, survives lost executors, stays columnar."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(steps: list[Callable[[], Found]]) -> list[Found]:
    """Results of steps that run Spark jobs and do not need each other, in the order given."""
    if len(steps) < 2:
        return [step() for step in steps]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        futures = [pool.submit(inheritable_thread_target(step)) for step in steps]
        return [f.result() for f in futures]
