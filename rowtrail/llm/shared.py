"""Helpers of this package: batches of texts, written tables, and checks of column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowtrail.sources.storage import shared_folder

SLICE_BYTES = 1 << 20
"""Texts are worked on in runs of about this many bytes, so a task's memory does not follow the batch size."""


class Scratch:
    """Tables written to the shared folder while an operator runs; ``drop`` deletes those no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.written = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write once and read back: cuts the plan and survives lost executors."""
        self.written += 1
        path = f"{self.folder}/{self.written}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)


SMALL_IDS = 4_000_000
"""At most so many ids are broadcast to filter a scan; more are joined by a shuffle."""


def with_ids(df: DataFrame, ids: DataFrame, name: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``name`` is among ``ids`` (or is not: ``left_anti``), a written table of one column without repeats."""
    return df.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, name, how)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; NULL is the empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    width = np.dtype("<i8" if wide else "<i4")
    o = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]] if len(o) else raw, o - (o[0] if len(o) else 0)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts [lo, hi) of about ``limit`` bytes; a longer text is a run of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def long_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An array column of longs from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))


def cleared(df: DataFrame, added: str) -> DataFrame:
    """``df`` without columns whose names, in any case, are among those of the schema ``added``."""
    taken = {f.name.lower() for f in StructType.fromDDL(added)}
    return df.select(*["`" + c.replace("`", "``") + "`" for c in df.columns if c.lower() not in taken])


def widened(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` followed by the columns of ``added``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
