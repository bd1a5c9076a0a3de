"""Coded id sets: the same ids as the edges, one row per output row."""

import pytest
from pyspark.sql import functions as F

from rowtrail import Trail, aggregate, join
from rowtrail.operators import coded, lineage


def as_set(df, *keys):
    return sorted(tuple(r[c] for c in [*keys, "table_id", "row_id"]) for r in df.collect())


@pytest.fixture
def sparse_and_dense(spark):
    """A hot group of 40,000 ids over two buckets, one with an id in each of many buckets, a NULL key, and a second table."""
    trail = Trail()
    n = F.col("id")
    key = F.when(n < 40_000, "hot").when(n % 32_768 == 7, "thin").when(n < 40_010, None).otherwise("rest")
    rows = spark.range(0, 300_000, 1, 6).select(n.alias("n"), key.alias("k"), (n % 3).alias("part")).filter("k <> 'rest' OR k IS NULL OR n % 50 = 0")
    left = trail.source(rows, "a", row_key="n")
    right = trail.source(spark.createDataFrame([(0, "hot"), (1, "thin")], "m bigint, k string"), "b", row_key="m")
    return join(left, right, on="k", how="left")


def test_sets_are_the_edges(sparse_and_dense):
    t = aggregate(sparse_and_dense, "k", dropna=False, c=("n", "count"))
    sets = coded.coded_sets(t, ["k"]).cache()
    want = lineage.edges(t, ["k"])
    assert as_set(coded.decoded_sets(sets, ["k"]).fillna("-"), "k") == as_set(want.fillna("-"), "k")
    counts = {r["k"]: r["_n"] for r in sets.collect()}
    assert counts == {r["k"]: r["count"] for r in want.groupBy("k").count().collect()} and counts["hot"] == 40_001
    hot = next(r["_sets"] for r in sets.collect() if r["k"] == "hot")
    assert [(s["table_id"], s["bucket"], s["n"]) for s in hot] == [(0, 0, 32768), (0, 1, 7232), (1, 0, 1)]
    assert hot[0]["listed"] is None and hot[2]["listed"] == [0] and hot[2]["bits"] is None


def test_merged_sets(sparse_and_dense):
    fine = aggregate(sparse_and_dense, ["k", "part"], dropna=False, c=("n", "count"))
    sets = coded.merged_sets(coded.coded_sets(fine, ["k", "part"]), ["k"])
    t = aggregate(sparse_and_dense, "k", dropna=False, c=("n", "count"))
    assert as_set(coded.decoded_sets(sets, ["k"]).fillna("-"), "k") == as_set(lineage.edges(t, ["k"]).fillna("-"), "k")


def test_empty(source):
    t = source(Trail(), "t", "k string, v bigint", ("a", 1)).filter("v > 1")
    sets = coded.coded_sets(aggregate(t, "k", n=("v", "count")), ["k"])
    assert sets.collect() == [] and coded.decoded_sets(sets, ["k"]).collect() == []
    assert coded.merged_sets(sets, ["k"]).collect() == []
