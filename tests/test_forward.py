"""Forward tracing from below: the same rows as filtering all edges, on every way of joining, and little work."""

import pytest
from pyspark.sql import functions as F

from rowtrail import Trail, aggregate, join
from rowtrail.operators import forward, lineage

WAYS = [{}, {"listed_ids": 0}, {"listed_ids": 0, "small_bytes": 0}]


@pytest.fixture
def shop(source):
    trail = Trail()
    orders = source(trail, "orders", "o bigint, c string", (1, "x"), (2, "x"), (3, "y"), (4, None), (5, "z"))
    items = source(trail, "items", "o bigint, v bigint", (1, 10), (1, 11), (3, 30), (4, 40), (9, 90))
    other = source(trail, "other", "k bigint", (1,), (2,))
    per_order = aggregate(items, "o", total=("v", "sum"))
    joined = join(orders, per_order, on="o", how="left")
    per_customer = aggregate(joined, "c", dropna=False, n=("o", "count"))
    back = join(orders, per_customer, on="c", how="left", null_keys="match")
    return trail, joined, per_customer, back, other


def inputs_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "table_id int, row_id bigint")


def by_edges(t, inputs, keys):
    hits = lineage.edges(t, keys).join(inputs.na.drop().distinct(), ["table_id", "row_id"], "left_semi")
    return sorted(tuple(map(str, r)) for r in hits.select(*keys).distinct().collect())


CASES = [
    [(0, 0)], [(0, 3)], [(1, 0), (1, 1), (1, 1)], [(1, 2), (0, 4)], [(1, 3)], [(1, 4)], [(2, 0)], [(7, 1)], [],
    [(None, 1), (1, None), (0, -1), (-1, 0), (70000, 0)], [(0, i) for i in range(5)],
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_same_as_edges(spark, shop, i):
    _, joined, per_customer, back, _ = shop
    inputs, way = inputs_of(spark, *CASES[i]), WAYS[i % 3]
    t, keys = [(back, ["o"]), (per_customer, ["c"]), (joined, ["o", "c"]), (per_customer, ["n"])][i % 4]
    got = forward.reached_keys(t, inputs, keys, **way)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == by_edges(t, inputs, keys)


@pytest.mark.parametrize("way, pairs", list(enumerate([CASES[1], CASES[3], CASES[2]])), ids=str)
def test_affected_and_the_rest_are_the_frame(spark, shop, tokens, pairs, way):
    back = shop[3]
    inputs = inputs_of(spark, *pairs)
    hit, rest = (forward.affected(back, inputs, r, **WAYS[way]) for r in (True, False))
    assert sorted((str(r["o"]),) for r in hit.df.collect()) == by_edges(back, inputs, ["o"])
    assert lineage.differences(hit.df.unionByName(rest.df), back.df).count() == 0
    whole = tokens(back, "o")
    assert all(whole[o] == own for o, own in tokens(hit, "o").items())


def test_whole_frame_aggregate_joined_to_rows(spark, source):
    trail = Trail()
    a = source(trail, "a", "k bigint, v bigint", (1, 5), (2, 6))
    total = aggregate(a, [], s=("v", "sum")).with_columns({"one": F.lit(1)})
    t = join(source(trail, "b", "k bigint, one int", (7, 1), (8, 1)), total, on="one")
    reach = lambda *p: sorted(r["k"] for r in forward.reached_keys(t, inputs_of(spark, *p), ["k"]).collect())
    assert reach((0, 1)) == [7, 8] and reach((1, 0)) == [7] and reach((2, 0)) == []


def test_same_source_twice(spark, source):
    trail = Trail()
    a = source(trail, "a", "k bigint, p bigint", (1, 2), (2, 3), (3, None))
    t = join(a, a, left_on="p", right_on="k", suffixes=("", "_up"))
    got = forward.affected(t, inputs_of(spark, (0, 1)))
    assert sorted(r["k"] for r in got.df.collect()) == [1, 2]


def test_untouched_tables_are_not_opened(spark, shop):
    _, _, _, back, other = shop
    t = join(back, aggregate(other, "k", n_other=("k", "count")), left_on="o", right_on="k", how="left")
    climb = forward._Climb(inputs_of(spark, (0, 0)), forward._nodes_below(t.nodes), 1000, 0)
    assert [climb.reached[n] is None for n in sorted(climb.reached)] == [True, False, True]


def test_wanted_ids_stand_at_the_scan(spark, shop, tmp_path):
    trail = Trail()
    spark.range(1000).select(F.col("id").alias("n"), (F.col("id") % 10).alias("k")).write.parquet(str(tmp_path / "t"))
    t = trail.source(spark.read.parquet(str(tmp_path / "t")), "t", row_key="n", unique=True)
    up = aggregate(join(t, aggregate(t, "k", c=("n", "count")), on="k"), "k", m=("n", "max"))
    node = up.fresh
    climb = forward._Climb(inputs_of(spark, (0, 5)), [], 1000, 1 << 20)
    (rows,) = climb.meeting(node.inputs, node.scalars, {})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # the filter is below the join: nothing but scans under it
    assert plan.index("Join") < plan.index("Filter") and "left_semi" not in plan
    assert rows.count() == 1
