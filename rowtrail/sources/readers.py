"""Files in, files out, row sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Scan CSV files with a header. The schema is declared: inferring it would read the data twice."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: dealt out evenly to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def hash_number(key: Column, seed: int | str = 0) -> Column:
    """A 32-bit number from md5(seed:key), the same in every engine and run."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sample_rows(df: DataFrame, key: str, fraction: float, seed: int | str = 0) -> DataFrame:
    """Keep about ``fraction`` of the rows, the same ones in every run: decided by the row's own key."""
    return df.filter(hash_number(F.col(key), seed) < F.lit(int(fraction * (1 << 32))))
