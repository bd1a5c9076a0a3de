"""Boosted trees beside SQL that grows the same trees: a few rounds, level by level, over the features' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail import aggregate, join
from rowtrail.features.base import Branches
from rowtrail.features.learn import Learner
from rowtrail.operators import lineage
from rowtrail.plans.registry import query, rounded
from rowtrail.plans.shop import ITEMS_SQL, LINES_SQL, SUMMARY_SQL, packed

FEATURES = ["least_quantity", "n_items", "largest_discount", "priority"]
ROUNDS, DEPTH, RATE, LEAST = 4, 3, 0.1, 20


def basket(shop):
    """Orders with items: features of their items (a discount is missing where there is one item only), and their value in thousands."""
    lines = shop.lines().with_columns({"percent": F.round(F.col("l_discount") * 100).cast("long"), "cents": F.round(F.col("l_extendedprice") * 100).cast("long")})
    items = aggregate(
        lines, "l_orderkey", least_quantity=("l_quantity", "min"), n_items=("l_quantity", "count"), largest_discount=("percent", "max"), cents=("cents", "sum")
    )
    orders = shop.tracked("orders", "o_orderkey").select("o_orderkey", "o_orderpriority")
    t = join(orders, items, left_on="o_orderkey", right_on="l_orderkey", how="inner")
    t = t.with_columns(
        {
            "largest_discount": F.when(F.col("n_items") > 1, F.col("largest_discount")),
            "priority": F.substring("o_orderpriority", 1, 1).cast("long"),
            "value": F.col("cents") / 100000,
        }
    )
    return t.rename({"o_orderkey": "order_id"}).select("order_id", "value", *FEATURES)


BASKET_SQL = f"""basket AS (SELECT o_orderkey AS order_id, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100000.0 AS value, min(l_quantity) AS least_quantity,
  count(*) AS n_items, CASE WHEN count(*) > 1 THEN CAST(max(round(l_discount * 100)) AS BIGINT) END AS largest_discount,
  CAST(any_value(o_orderpriority)[1] AS BIGINT) AS priority FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def boosted_sql(rows: str, classes: bool) -> str:
    """CTEs up to ``b<ROUNDS>_0`` (the rows with ``raw``) from a table with order_id, y and the features.

    Per level: sums per node, feature and value; running sums are the left sides of splits, with and without the missing values; the
    best split of each node moves its rows to nodes 2n and 2n + 1. A node without a split keeps its rows under a negative number.
    """
    p = "(1 / (1 + exp(-raw)))"
    g, h = (f"{p} - y", f"{p} * (1 - {p})") if classes else ("raw - y", "1.0")
    start = "ln(avg(y) / (1 - avg(y)))" if classes else "avg(y)"
    parts = [f"b0_0 AS (SELECT *, (SELECT {start} FROM {rows}) AS raw, 1 AS node FROM {rows})"]
    for t in range(ROUNDS):
        for d in range(DEPTH):
            b, x = f"b{t}_{d}", f"{t}_{d}"
            sides = " UNION ALL ".join(f"SELECT node, {i} AS f, CAST({c} AS DOUBLE) AS v, {g} AS g, {h} AS h FROM {b} WHERE node > 0" for i, c in enumerate(FEATURES))
            value = "CASE s.f " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(FEATURES)) + " END"
            parts += [
                f"s{x} AS (SELECT node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({sides}) GROUP BY node, f, v)",
                f"w{x} AS (SELECT node, sum(g) AS gt, sum(h) AS ht, sum(n) AS nt FROM s{x} WHERE f = 0 GROUP BY node)",
                f"m{x} AS (SELECT node, f, g AS gm, h AS hm, n AS nm FROM s{x} WHERE v IS NULL)",
                f"l{x} AS (SELECT node, f, v, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER u AS nl FROM s{x} WHERE v IS NOT NULL WINDOW u AS (PARTITION BY node, f ORDER BY v))",
                f"""c{x} AS (SELECT l.node, l.f, v, side, gl + side * coalesce(gm, 0) AS gl, hl + side * coalesce(hm, 0) AS hl, nl + side * coalesce(nm, 0) AS nl,
                  gt, ht, nt, coalesce(nm, 0) AS nm FROM l{x} l JOIN w{x} w ON w.node = l.node LEFT JOIN m{x} m ON m.node = l.node AND m.f = l.f,
                  (VALUES (0), (1)) z(side) WHERE side = 0 OR nm > 0)""",
                f"""k{x} AS (SELECT *, gl * gl / hl + (gt - gl) * (gt - gl) / (ht - hl) - gt * gt / ht AS gain FROM c{x}
                  WHERE nl >= {LEAST} AND nt - nl >= {LEAST} AND hl >= 0.001 AND ht - hl >= 0.001)""",
                f"""t{x} AS (SELECT node, f, v, CASE WHEN nm > 0 THEN side = 1 ELSE nl > nt - nl END AS missing_left FROM k{x} WHERE gain > 1e-10
                  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v, side) = 1)""",
                f"""b{t}_{d + 1} AS (SELECT b.* EXCLUDE (node), CASE WHEN b.node < 0 THEN b.node WHEN s.node IS NULL THEN -b.node
                  WHEN CASE WHEN {value} IS NULL THEN missing_left ELSE {value} <= s.v END THEN 2 * b.node ELSE 2 * b.node + 1 END AS node
                  FROM {b} b LEFT JOIN t{x} s ON s.node = b.node)""",
            ]
        b = f"b{t}_{DEPTH}"
        parts += [
            f"v{t} AS (SELECT node, -{RATE} * sum({g}) / sum({h}) AS add FROM {b} GROUP BY node)",
            f"b{t + 1}_0 AS (SELECT b.* EXCLUDE (node) REPLACE (raw + add AS raw), 1 AS node FROM {b} b JOIN v{t} v ON v.node = b.node)",
        ]
    return ", ".join(parts)


def boosted(t, label: str, kind: str):
    step = Branches([], keep=("order_id", label), remainder="passthrough")
    learner = Learner([step], label, kind, iterations=ROUNDS, depth=DEPTH, rate=RATE, early_stopping=False)
    return learner.fit(t).predict(t)


EDGES_SQL = f"""e AS (SELECT order_id, {packed(1, 'order_id')} AS pid FROM basket UNION ALL SELECT order_id, {packed(0, 'rid')} FROM items),
  s AS (SELECT order_id, {SUMMARY_SQL} FROM e GROUP BY order_id)"""


@query(
    "boosted_values",
    f"""WITH {LINES_SQL}, {ITEMS_SQL}, {BASKET_SQL}, r AS (SELECT * EXCLUDE (value), value AS y FROM basket), {boosted_sql('r', False)}, {EDGES_SQL}
    SELECT b.order_id, round(y, 6) AS value, round(raw, 6) AS prediction, prov_n, prov_min, prov_max, prov_xor FROM b{ROUNDS}_0 b JOIN s ON s.order_id = b.order_id""",
)
def boosted_values(shop):
    """The value of an order by regression."""
    t = basket(shop).stored("basket")
    found = boosted(t, "value", "regressor").select("order_id", "value", "prediction")
    return rounded(lineage.with_summary(found, ["order_id"]), ["value", "prediction"])


@query(
    "boosted_chances",
    f"""WITH {BASKET_SQL}, r AS (SELECT * EXCLUDE (value), CAST(value > 150 AS INT) AS y FROM basket), {boosted_sql('r', True)}
    SELECT order_id, y AS is_large, CAST(raw > 0 AS DOUBLE) AS prediction, round(1 / (1 + exp(-raw)), 6) AS probability FROM b{ROUNDS}_0""",
)
def boosted_chances(shop):
    """The chance that an order is a large one."""
    t = basket(shop).with_columns({"is_large": (F.col("value") > 150).cast("int")}).drop("value").stored("basket")
    return rounded(boosted(t, "is_large", "classifier").untracked().select("order_id", "is_large", "prediction", "probability"), ["probability"])
