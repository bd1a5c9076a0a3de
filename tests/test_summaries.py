"""Summaries of rows that share groups, and of long chains."""

from dataclasses import replace

from pyspark.sql import functions as F

from rowtrail import Trail, aggregate, join
from rowtrail.operators import lineage
from rowtrail.plans.chain import chain


def by_edges(t, keys):
    pid = F.col("table_id").cast("long") * F.lit(1 << 48) + F.col("row_id")
    found = lineage.edges(t, keys).select(*keys, pid.alias("_pid"))
    return sorted(map(tuple, found.groupBy(*keys).agg(*lineage.summed()).collect()), key=repr)


def shared_groups(source, trail):
    members = source(trail, "members", "g string, x int", *[("ab"[i % 2], i) for i in range(50)], (None, 1))
    members = replace(members, exact=True)
    groups = aggregate(members, "g", n=("x", "count"))
    rows = source(trail, "rows", "k int, g string", (1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (None, "a"), (None, None))
    return rows, groups, join(rows, groups, on="g", how="left")


def test_shared_groups_repeated_and_null_keys(source):
    _, _, t = shared_groups(source, Trail())
    found = sorted(map(tuple, lineage.summary(t, ["k"]).collect()), key=repr)
    assert found == by_edges(t, ["k"])
    assert (1, 3 + 50) in [r[:2] for r in found]


def test_rows_are_not_multiplied_by_members(source, monkeypatch):
    _, _, t = shared_groups(source, Trail())
    opened = []
    walk = lineage._walk
    monkeypatch.setattr(lineage, "_walk", lambda *a, **k: [opened.append(walk(*a, **k)) or opened[-1]][0])
    lineage.summary(t, ["k"])
    frames = opened[0] if isinstance(opened[0], list) else [opened[0]]
    assert sum(f.count() for f in frames) == 7  # the rows themselves; the edges are 7 + 4 * 25


def test_a_table_reached_on_two_paths_counts_once(source):
    trail = Trail()
    rows, groups, t = shared_groups(source, trail)
    again = join(t.select("k", "g"), groups.select("g").rename({"g": "h"}), left_on="g", right_on="h", how="left")
    assert sorted(map(tuple, lineage.summary(again, ["k"]).collect()), key=repr) == by_edges(again, ["k"])
    own = join(rows, aggregate(rows, "g", n=("k", "count")), on="g", how="left")
    assert sorted(map(tuple, lineage.summary(own, ["k"]).collect()), key=repr) == by_edges(own, ["k"])


def test_the_plan_of_a_chain_grows_with_its_steps(source, spark):
    trail = Trail()
    fact = source(trail, "facts", "category string, user_id int", *[("ab"[i % 2], i % 5) for i in range(20)])
    lookup = spark.range(5).select(F.col("id").cast("int").alias("user_id"), F.lit("x").alias("country"), F.col("id").alias("lookup_row"))
    t = chain(trail, fact, lookup, 6)
    found = lineage.summary(t, ["category", "user_id"])
    assert sorted(map(tuple, found.collect()), key=repr) == by_edges(t, ["category", "user_id"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2 * 6


def test_groups_of_lines_meet_in_as_many_tasks_as_asked_for(spark, monkeypatch):
    from rowtrail.plans import lineage_queries, row_queries, shop

    monkeypatch.setattr(shop, "LINES_PER_TASK", 500, raising=False)
    at = shop.Shop(spark, "/root/testdata/sf0.001")
    assert at.tasks >= at.numbered_lines.count() / 500
    kept = []
    monkeypatch.setattr(lineage_queries, "compared", lambda a, b: kept.extend((a, b)) or a)
    monkeypatch.setattr(row_queries.lineage, "with_summary", lambda t, keys: kept.append(t.df))
    lineage_queries.invariance(at)
    row_queries.src_two_names(at)
    # dealt by an explicit number, which adaptive execution leaves alone: one aggregate each in the first two, two in the third
    plans = [df._jdf.queryExecution().optimizedPlan().toString().splitlines() for df in kept]
    dealt = [[line for line in plan if "RepartitionByExpression" in line] for plan in plans]
    assert [len(lines) for lines in dealt] == [1, 1, 2]
    assert all(line.rstrip().endswith(f", {at.tasks}") for lines in dealt for line in lines)
