"""Lineage itself: edges, traces, consolidation, sizes, checks, chains of aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail import aggregate, join
from rowtrail.operators import coded, forward, lineage
from rowtrail.plans.chain import chain, plain_chain, shop_chain_inputs
from rowtrail.plans.registry import query, shown
from rowtrail.plans.shop import ITEMS_SQL, LINE_ORDER, LINES_SQL, SUMMARY_SQL, packed
from rowtrail.sources.numbering import number_rows

MASK = (1 << 48) - 1
DECODED = f"(pid >> 48)::INT AS table_id, pid & {MASK} AS row_id"

# customers over orders over lines: two aggregates, a left join between them
TWO_LEVELS = f"""{LINES_SQL}, {ITEMS_SQL}, e AS (SELECT o_custkey AS customer_id, {packed(0, 'o_orderkey')} AS pid FROM orders
  UNION ALL SELECT o_custkey, {packed(1, 'rid')} FROM orders JOIN items ON order_id = o_orderkey)"""


def two_levels(shop):
    orders = shop.tracked("orders", "o_orderkey").rename({"o_orderkey": "order_id", "o_custkey": "customer_id"})
    items = aggregate(shop.order_items(), "order_id", total=("price_cents", "sum"), n=("item_id", "count"))
    t = join(orders.select("order_id", "customer_id"), items, on="order_id", how="left")
    return aggregate(t, "customer_id", n_orders=("order_id", "count"), total=("total", "sum"))


@query("edges", f"WITH {TWO_LEVELS} SELECT customer_id, {DECODED} FROM e")
def edges(shop):
    return lineage.edges(two_levels(shop), ["customer_id"])


@query("edge_tokens", f"""WITH {TWO_LEVELS} SELECT customer_id, CASE WHEN pid >> 48 = 0 THEN 'orders:' ELSE 'order_items:' END
    || (pid & {MASK}) AS token FROM e""")
def edge_tokens(shop):
    return lineage.token_edges(two_levels(shop), ["customer_id"])


@query("edges_stored", f"WITH {TWO_LEVELS} SELECT customer_id, count(*) AS n FROM e GROUP BY customer_id")
def edges_stored(shop):
    stored = lineage.store_edges(two_levels(shop), ["customer_id"])
    return stored.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


@query("trace_back", f"WITH {TWO_LEVELS} SELECT customer_id, {DECODED} FROM e WHERE customer_id IN (7, 77, 777)")
def trace_back(shop):
    return lineage.trace_back(two_levels(shop), F.col("customer_id").isin(7, 77, 777), ["customer_id"])


@query(
    "trace_forward",
    f"""WITH {TWO_LEVELS} SELECT DISTINCT customer_id FROM e WHERE pid IN
    (SELECT {packed(1, 'rid')} FROM lines WHERE l_suppkey = 5)""",
)
def trace_forward(shop):
    t = two_levels(shop)
    wanted = shop.numbered_lines.filter("l_suppkey = 5").select(
        F.lit(shop.trail.table_id("order_items")).alias("table_id"), F.col("line_row").alias("row_id")
    )
    return lineage.trace_forward(t, wanted, ["customer_id"])


def wanted_inputs(shop):
    """The lines of supplier 5 and the orders whose key ends in 77, as input rows."""
    lines = shop.numbered_lines.filter("l_suppkey = 5").select(
        F.lit(shop.trail.table_id("order_items")).alias("table_id"), F.col("line_row").alias("row_id")
    )
    orders = shop.table("orders").filter("o_orderkey % 100 = 77").select(
        F.lit(shop.trail.table_id("orders")).alias("table_id"), F.col("o_orderkey").alias("row_id")
    )
    return lines.unionByName(orders)


REACHED_SQL = f"""{TWO_LEVELS}, hit AS (SELECT customer_id FROM e WHERE pid IN (SELECT {packed(1, 'rid')} FROM lines WHERE l_suppkey = 5)
  UNION SELECT o_custkey FROM orders WHERE o_orderkey % 100 = 77)"""


@query("trace_forward_tables", f"WITH {REACHED_SQL} SELECT customer_id FROM hit")
def trace_forward_tables(shop):
    return lineage.trace_forward(two_levels(shop), wanted_inputs(shop), ["customer_id"])


def customers_with_orders(shop):
    """Orders beside the totals of their customer: a row has its own order and, through two aggregates, all of the customer's rows behind it."""
    t = two_levels(shop).select("customer_id", "n_orders")
    orders = shop.tracked("orders", "o_orderkey").rename({"o_orderkey": "order_id", "o_custkey": "customer_id"})
    return join(orders.select("order_id", "customer_id"), t, on="customer_id", how="left")


AFFECTED_SQL = """SELECT o_orderkey AS order_id, o_custkey AS customer_id, count(*) OVER (PARTITION BY o_custkey) AS n_orders FROM orders"""


@query("affected_rows", f"WITH {REACHED_SQL}, a AS ({AFFECTED_SQL}) SELECT * FROM a WHERE customer_id IN (SELECT customer_id FROM hit)")
def affected_rows(shop):
    return forward.affected(customers_with_orders(shop), wanted_inputs(shop)).untracked()


@query("unaffected_rows", f"WITH {REACHED_SQL}, a AS ({AFFECTED_SQL}) SELECT * FROM a WHERE customer_id NOT IN (SELECT customer_id FROM hit)")
def unaffected_rows(shop):
    return forward.affected(customers_with_orders(shop), wanted_inputs(shop), reached=False).untracked()


@query(
    "compose_edges",
    f"WITH {TWO_LEVELS} SELECT customer_id, 0 AS table_id, pid & {MASK} AS row_id FROM e WHERE pid >> 48 = 1",
)
def compose_edges(shop):
    items = aggregate(shop.order_items(), "order_id", total=("price_cents", "sum"))
    lower = lineage.store_edges(items, ["order_id"])
    upper = shop.table("orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"))
    return lineage.compose(upper, lower, ["order_id"])


@query(
    "consolidate",
    f"""WITH {LINES_SQL}, a AS (SELECT l_orderkey, count(*) AS n, string_agg('lineitem:' || rid, ',' ORDER BY rid) AS toks FROM lines GROUP BY 1)
    SELECT o_orderkey, n, 1 + coalesce(n, 0) AS prov_n, 'orders:' || o_orderkey || coalesce(',' || toks, '') AS prov
    FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""",
)
def consolidate(shop):
    orders = shop.tracked("orders", "o_orderkey").select("o_orderkey")
    lines = aggregate(shop.lines(), "l_orderkey", n=("l_linenumber", "count"))
    t = join(orders, lines, left_on="o_orderkey", right_on="l_orderkey", how="left")
    return shown(t.select("o_orderkey", "n"))


@query(
    "consolidate_hot_groups",
    f"""WITH {LINES_SQL},
    p AS (SELECT l_returnflag, (row_number() OVER (PARTITION BY l_returnflag ORDER BY rid) - 1) // 1024 AS part, rid FROM lines)
    SELECT l_returnflag, part, count(*) AS prov_n, min(rid) AS first, max(rid) AS last, bit_xor(rid) AS prov_xor, sum(rid)::BIGINT AS prov_sum
    FROM p GROUP BY 1, 2""",
)
def consolidate_hot_groups(shop):
    # three groups share the whole table: each comes in parts of at most 1024 ids, nothing is left out
    t = aggregate(shop.lines(), "l_returnflag", n=("l_linenumber", "count"))
    ids = F.col("_prov")
    return lineage.set_parts(t, ["l_returnflag"], part_ids=1024).select(
        "l_returnflag", F.col("_part").alias("part"), F.size(ids).cast("long").alias("prov_n"), ids[0].alias("first"),
        F.element_at(ids, -1).alias("last"),
        F.aggregate(ids, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias("prov_xor"),
        F.aggregate(ids, F.lit(0).cast("long"), lambda x, y: x + y).alias("prov_sum"),
    )


CODED_SQL = f"""WITH {LINES_SQL} SELECT l_returnflag, count(*) AS prov_n, min(rid) AS first, max(rid) AS last, bit_xor(rid) AS prov_xor, sum(rid)::BIGINT AS prov_sum
  FROM lines GROUP BY l_returnflag"""


def decoded_summary(sets):
    """Counts kept with the sets, beside what their decoded ids give."""
    found = coded.decoded_sets(sets, ["l_returnflag"]).groupBy("l_returnflag").agg(
        F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.bit_xor("row_id").alias("prov_xor"), F.sum("row_id").alias("prov_sum")
    )
    return sets.select("l_returnflag", F.col("_n").alias("prov_n")).join(found, "l_returnflag")


@query("coded_groups", CODED_SQL)
def coded_groups(shop):
    """Three groups share the whole table: one row each, whatever their size."""
    t = aggregate(shop.lines(), "l_returnflag", n=("l_linenumber", "count"))
    return decoded_summary(coded.coded_sets(t, ["l_returnflag"]))


@query("coded_merged", CODED_SQL)
def coded_merged(shop):
    """The same from the sets of smaller groups, some listed and some as bitmaps, merged without going back to the rows."""
    t = aggregate(shop.lines(), ["l_returnflag", "l_linestatus", "l_quantity"], n=("l_linenumber", "count"))
    return decoded_summary(coded.merged_sets(coded.coded_sets(t, ["l_returnflag", "l_linestatus", "l_quantity"]), ["l_returnflag"]))


@query(
    "edges_factored",
    f"""WITH {LINES_SQL}, g AS (SELECT DISTINCT l_returnflag FROM lines),
    r AS (SELECT o_orderkey, 0 AS table_id, o_orderkey AS row_id, NULL AS flag FROM orders
      UNION ALL SELECT o_orderkey, NULL, NULL, l_returnflag FROM orders JOIN g ON l_returnflag = substr('ANR', 1 + (o_orderkey % 3)::INT, 1)),
    m AS (SELECT NULL::BIGINT AS o_orderkey, 1 AS table_id, rid AS row_id, l_returnflag AS flag FROM lines)
    SELECT * FROM r UNION ALL SELECT * FROM m""",
)
def edges_factored(shop):
    # every order refers to one of three groups that share the whole table: rows and members, not rows times members
    orders = shop.tracked("orders", "o_orderkey").select("o_orderkey")
    orders = orders.with_columns({"flag": F.substring(F.lit("ANR"), F.col("o_orderkey") % 3 + 1, F.lit(1))})
    lines = aggregate(shop.lines(), "l_returnflag", n=("l_linenumber", "count"))
    rows, members = lineage.factored(join(orders, lines, left_on="flag", right_on="l_returnflag", how="left"), ["o_orderkey"])
    both = rows.unionByName(members.withColumn("o_orderkey", F.lit(None).cast("long")))
    return both.withColumn("flag", F.get_json_object(F.substring_index("group", ":", -2), "$.l_returnflag")).drop("group")


@query(
    "agg_global_filtered",
    f"""WITH {LINES_SQL} SELECT n, (pid >> 48)::INT AS table_id, pid & 281474976710655 AS row_id
    FROM (SELECT count(*) AS n FROM lines) JOIN (SELECT {packed(0, 'rid')} AS pid FROM lines) ON n > 0""",
)
def agg_global_filtered(shop):
    t = aggregate(shop.lines(), n=("l_linenumber", "count")).with_columns({"twice": F.col("n") * 2})
    return lineage.edges(t.filter("twice > 0"), ["n"])


@query(
    "footprint",
    f"""WITH {TWO_LEVELS}, n AS (SELECT customer_id, (pid >> 48)::INT AS table_id, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT table_id, CAST(sum(n) AS BIGINT) AS edges, max(n) AS largest, CAST(sum(n) * 8 AS BIGINT) AS bytes FROM n GROUP BY table_id""",
)
def footprint(shop):
    return lineage.footprint(two_levels(shop))


@query("invariance", "SELECT count(*) AS n_rows, 0::BIGINT AS n_differences FROM orders WHERE o_orderstatus = 'F'")
def invariance(shop):
    orders, items = shop.table("orders"), shop.numbered_lines
    plain = (
        items.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.max("l_shipdate").alias("last"))
        .repartition(shop.tasks, "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "right")
        .filter("o_orderstatus = 'F'").select("o_orderkey", "n", "last")
    )
    lines = aggregate(shop.lines(), "l_orderkey", n=("l_linenumber", "count"), last=("l_shipdate", "max")).dealt(shop.tasks, "l_orderkey")
    t = join(lines, shop.tracked("orders", "o_orderkey"), left_on="l_orderkey", right_on="o_orderkey", how="right")
    t = t.filter("o_orderstatus = 'F'").select("o_orderkey", "n", "last")
    return compared(t.untracked(), plain)


def compared(a, b):
    """How many rows were compared, of the first frame, and how many differ."""
    differing = lineage.differences(a, b).agg(F.count(F.lit(1)).alias("n_differences"))
    return a.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", differing.scalar().alias("n_differences"))


@query("determinism", "SELECT count(*) AS n_rows, 0::BIGINT AS n_differences FROM lineitem")
def determinism(shop):
    # the raw table is numbered a second time, dealt out and ordered in another way
    again = number_rows(shop.table("lineitem").repartition(13), LINE_ORDER, "line_row")
    return compared(again, shop.numbered_lines)


CHAIN_STEPS = 10


def _chain_sql() -> str:
    groups = "SELECT DISTINCT o_orderpriority AS category, o_custkey AS user_id FROM orders"
    lookups = " ".join(
        f"UNION ALL SELECT category, user_id, {packed(i + 1, 'user_id')} FROM g" for i in range(CHAIN_STEPS)
    )
    return f"""WITH g AS ({groups}), e AS (SELECT o_orderpriority AS category, o_custkey AS user_id, {packed(0, 'o_orderkey')} AS pid
      FROM orders {lookups}) SELECT category, user_id, 1::BIGINT AS country_count, {SUMMARY_SQL} FROM e GROUP BY category, user_id"""


@query("compose_chain", _chain_sql())
def compose_chain(shop):
    fact, lookup = shop_chain_inputs(shop)
    t = chain(shop.trail, fact, lookup, CHAIN_STEPS)
    return lineage.with_summary(t, ["category", "user_id"])


@query("chain_untracked", """SELECT o_orderpriority AS category, o_custkey AS user_id, 1::BIGINT AS country_count
    FROM orders GROUP BY 1, 2""")
def chain_untracked(shop):
    fact, lookup = shop_chain_inputs(shop)
    return plain_chain(fact.untracked(), lookup, CHAIN_STEPS)
