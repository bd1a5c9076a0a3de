import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtrail import Trail
from rowtrail.functions import ids
from rowtrail.functions.quantiles import exact_quantiles
from rowtrail.sources.numbering import number_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions", [1, 7, 64])
@pytest.mark.parametrize("max_cell_rows", [10**6, 10])
def test_numbers_do_not_depend_on_partitions_or_path(spark, partitions, max_cell_rows):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").repartition(partitions)
    out = number_rows(df, df.columns, "r", max_cell_rows).toPandas()
    expected = df.toPandas().sort_values(df.columns).reset_index(drop=True)
    got = out.sort_values("r").reset_index(drop=True)
    assert (got["r"] == np.arange(len(got))).all()
    assert got[df.columns].equals(expected[df.columns])


def test_text_key_hot_key_and_copies(spark):
    # one key holds a third of the rows, and half of those are copies of one row
    rows = [("hot", 0)] * 500 + [("hot", i) for i in range(500)] + [(f"k{i:04d}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(5)
    got = sorted((r["r"], r["k"], r["v"]) for r in number_rows(df, ["k", "v"], "r").collect())
    assert [(k, v) for _, k, v in got] == sorted(rows)
    assert [r for r, _, _ in got] == list(range(len(rows)))


def test_pack_and_unpack_extremes(spark):
    df = spark.range(1).select(
        ids.pack(40000, F.lit(ids.MAX_ROW)).alias("a"), ids.pack(65535, F.lit(0)).alias("b")
    )
    row = df.select(
        ids.table_of(F.col("a")), ids.row_of(F.col("a")), ids.table_of(F.col("b")), ids.row_of(F.col("b")),
        ids.token(F.col("a"), {40000: "t"}),
    ).first()
    assert tuple(row) == (40000, ids.MAX_ROW, 65535, 0, f"t:{ids.MAX_ROW}")
    with pytest.raises(ValueError):
        ids.pack(65536, F.lit(0))


def test_source_checks(spark):
    df = spark.createDataFrame([(0, 1.0), (0, float("nan"))], "k bigint, x double")
    with pytest.raises(ValueError):
        Trail().source(df, "t", row_key="k", verify=True)
    with pytest.raises(ValueError):
        Trail().source(df, "t")
    with pytest.raises(ValueError):
        Trail().source(df.withColumn("_prov9", F.lit(1)), "t", row_key="k")
    assert Trail().source(df, "t", row_key="k").df.filter("x is null").count() == 1


@pytest.mark.parametrize("small", [10**6, 0])
def test_exact_quantiles_both_ways(spark, small):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4001)
    hot = np.where(rng.random(4001) < 0.4, 5.0, rng.integers(0, 50, 4001)).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, hot)], "x double, hot double, none double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x", "hot"], probs, small_distinct=small, settle_distinct=8)
    assert got["x"] == pytest.approx(list(np.quantile(x, probs)))
    assert got["hot"] == pytest.approx(list(np.quantile(hot, probs)))
    assert exact_quantiles(df, ["none"], [0.5])["none"] == [None]


def test_no_task_numbers_more_rows_than_a_part(spark, monkeypatch):
    from rowtrail.sources import numbering

    monkeypatch.setattr(numbering, "ROWS_PER_PART", 500, raising=False)
    monkeypatch.setattr(numbering, "MIN_PART_ROWS", 500, raising=False)
    rows = [(None, 0)] * 3 + [(i // 3, i % 3) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(5)
    out = number_rows(df, ["k", "v"], "r")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 500 and sum(sizes) == len(rows)
    assert [(r["k"], r["v"]) for r in out.orderBy("r").collect()] == rows
    assert {r["r"] for r in out.collect()} == set(range(len(rows)))


def test_differences_count_repeats_and_nulls_in_one_pass(spark):
    from rowtrail.operators import lineage

    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (None, "y"), (2, None)], "k bigint, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (None, "y"), (3, "z"), (2, None)], "k bigint, v string")
    found = lineage.differences(a, b)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, "x", "first"), (1, "x", "first"), (None, "y", "second"), (3, "z", "second")], key=repr
    )
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
