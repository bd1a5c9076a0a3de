"""Joins: all forms, with the ids of both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail import aggregate, join
from rowtrail.features.encoding import TargetEncoder
from rowtrail.operators import lineage
from rowtrail.plans.registry import query, rounded, shown
from rowtrail.plans.shop import (
    CUSTOMERS_SQL, GEO_SQL, ITEMS_SQL, LINES_SQL, PRODUCTS_SQL, REVIEWS_SQL, SUMMARY_SQL, TRANSLATIONS_SQL, packed,
)


@query(
    "join_inner",
    f"""WITH {LINES_SQL}, {ITEMS_SQL}, {PRODUCTS_SQL} SELECT i.order_id, i.item_id, i.product_id, category, price_cents, 
    2::BIGINT AS prov_n, 'order_items:' || rid || ',products:' || p.product_id AS prov
    FROM items i JOIN products p ON i.product_id = p.product_id""",
)
def join_inner(shop):
    t = join(shop.order_items(), shop.products(), on="product_id", how="inner")
    return shown(t.select("order_id", "item_id", "product_id", "category", "price_cents"))


@query(
    "join_left",
    f"""WITH {LINES_SQL}, {ITEMS_SQL} SELECT o_orderkey AS order_id, o_orderstatus, item_id, price_cents, 
    CASE WHEN rid IS NULL THEN 1::BIGINT ELSE 2::BIGINT END AS prov_n,
    'orders:' || o_orderkey || coalesce(',order_items:' || rid, '') AS prov
    FROM orders LEFT JOIN items ON order_id = o_orderkey""",
)
def join_left(shop):
    orders = shop.tracked("orders", "o_orderkey").rename({"o_orderkey": "order_id"})
    t = join(orders, shop.order_items(), on="order_id", how="left")
    return shown(t.select("order_id", "o_orderstatus", "item_id", "price_cents"))


@query(
    "join_right",
    f"""WITH {REVIEWS_SQL} SELECT o_orderkey AS order_id, review_score, o_orderstatus, 
    CASE WHEN order_id IS NULL THEN 1::BIGINT ELSE 2::BIGINT END AS prov_n,
    coalesce('reviews:' || order_id || ',', '') || 'orders:' || o_orderkey AS prov
    FROM reviews RIGHT JOIN orders ON order_id = o_orderkey""",
)
def join_right(shop):
    reviews = shop.reviews()
    orders = shop.tracked("orders", "o_orderkey").rename({"o_orderkey": "order_id"})
    return shown(join(reviews, orders, on="order_id", how="right").select("order_id", "review_score", "o_orderstatus"))


@query(
    "join_keys_renamed",
    f"""WITH {CUSTOMERS_SQL}, {GEO_SQL},
    f AS (SELECT * FROM geo QUALIFY row_number() OVER (PARTITION BY geo_zip ORDER BY gid) = 1)
    SELECT customer_id, zip, geo_zip, lat, lng, city, CASE WHEN gid IS NULL THEN 1::BIGINT ELSE 2::BIGINT END AS prov_n,
    'customers:' || customer_id || coalesce(',geolocation:' || gid, '') AS prov
    FROM customers LEFT JOIN f ON zip = geo_zip""",
)
def join_keys_renamed(shop):
    geo = shop.customers(), shop.geolocation().first_per_key(["geo_zip"])
    t = join(*geo, left_on="zip", right_on="geo_zip", how="left")
    return shown(t.select("customer_id", "zip", "geo_zip", "lat", "lng", "city"))


@query(
    "join_chain",
    f"""WITH {LINES_SQL}, {ITEMS_SQL}, {PRODUCTS_SQL}, {CUSTOMERS_SQL}, {TRANSLATIONS_SQL}
    SELECT o_orderkey AS order_id, item_id, p.category, category_en, state, 
    2 + CAST(rid IS NOT NULL AS BIGINT) * 2 + CAST(trid IS NOT NULL AS BIGINT) AS prov_n,
    'orders:' || o_orderkey || coalesce(',order_items:' || rid || ',products:' || p.product_id, '') || coalesce(',translations:' || trid, '')
      || ',customers:' || customer_id AS prov
    FROM orders LEFT JOIN items i ON i.order_id = o_orderkey LEFT JOIN products p ON p.product_id = i.product_id
    LEFT JOIN translations t ON t.category = p.category LEFT JOIN customers c ON customer_id = o_custkey""",
)
def join_chain(shop):
    orders = shop.tracked("orders", "o_orderkey").rename({"o_orderkey": "order_id", "o_custkey": "customer_id"})
    t = join(orders, shop.order_items(), on="order_id", how="left")
    t = join(t, shop.products(), on="product_id", how="left")
    t = join(t, shop.translations(), on="category", how="left")
    t = join(t, shop.customers(), on="customer_id", how="left")
    return shown(t.select("order_id", "item_id", "category", "category_en", "state"))


@query(
    "join_same_source",
    f"""WITH {PRODUCTS_SQL}
    SELECT a.product_id, b.product_id AS product_id_b, a.weight, 
    CASE WHEN a.product_id = b.product_id THEN 1::BIGINT ELSE 2::BIGINT END AS prov_n,
    CASE WHEN a.product_id = b.product_id THEN 'products:' || a.product_id
      ELSE 'products:' || least(a.product_id, b.product_id) || ',products:' || greatest(a.product_id, b.product_id) END AS prov
    FROM products a LEFT JOIN products b ON b.product_id = a.product_id + 1 - 2 * (a.product_id % 2)""",
)
def join_same_source(shop):
    a = shop.products().with_columns({"neighbour": F.expr("product_id + 1 - 2 * (product_id % 2)")})
    t = join(a, shop.products(), left_on="neighbour", right_on="product_id", how="left", suffixes=("", "_b"))
    return shown(t.select("product_id", "product_id_b", "weight"))


@query(
    "join_repeated_lookup",
    """SELECT order_id, state, state_b, state_c, 2::BIGINT AS prov_n, prov FROM (
    SELECT o_orderkey AS order_id, c_mktsegment AS state, c_mktsegment AS state_b, c_mktsegment AS state_c,
    'orders:' || o_orderkey || ',customers:' || c_custkey AS prov FROM orders JOIN customer ON c_custkey = o_custkey)""",
)
def join_repeated_lookup(shop):
    orders = shop.tracked("orders", "o_orderkey").rename({"o_orderkey": "order_id", "o_custkey": "customer_id"})
    lookup = shop.customers().select("customer_id", "state")
    t = join(orders.select("order_id", "customer_id"), lookup, on="customer_id")
    t = join(t, lookup, on="customer_id", suffixes=("", "_b"))
    t = join(t, lookup, on="customer_id", suffixes=("", "_c"))
    return shown(t.select("order_id", "state", "state_b", "state_c"))


@query(
    "join_on_agg",
    f"""WITH {LINES_SQL}, {ITEMS_SQL},
    a AS (SELECT order_id, count(*) AS n_items, CAST(sum(price_cents) AS BIGINT) AS total_cents FROM items GROUP BY order_id),
    e AS (SELECT o_orderkey AS order_id, {packed(0, 'o_orderkey')} AS pid FROM orders
      UNION ALL SELECT order_id, {packed(1, 'rid')} FROM items),
    s AS (SELECT order_id, {SUMMARY_SQL} FROM e GROUP BY order_id)
    SELECT o_orderkey AS order_id, o_orderstatus, n_items, total_cents, prov_n, prov_min, prov_max, prov_xor
    FROM orders LEFT JOIN a ON a.order_id = o_orderkey JOIN s ON s.order_id = o_orderkey""",
)
def join_on_agg(shop):
    orders = shop.tracked("orders", "o_orderkey").rename({"o_orderkey": "order_id"}).select("order_id", "o_orderstatus")
    items = aggregate(shop.order_items(), "order_id", n_items=("item_id", "count"), total_cents=("price_cents", "sum"))
    return lineage.with_summary(join(orders, items, on="order_id", how="left"), ["order_id"])


@query(
    "join_category_stats",
    f"""WITH {PRODUCTS_SQL}, s AS (SELECT category, avg(weight) AS mean_weight FROM products GROUP BY category)
    SELECT product_id, p.category, round(mean_weight, 6) AS mean_weight, prov_n, prov FROM
    (SELECT product_id, category, 1::BIGINT AS prov_n, 'products:' || product_id AS prov FROM products) p
    LEFT JOIN s ON s.category = p.category""",
)
def join_category_stats(shop):
    # training statistics joined back as constants: like a fitted encoder they add no ids
    t = shop.products().select("product_id", "category", "weight")
    t = TargetEncoder("category", "weight", "mean_weight").fit(t).transform(t)
    return rounded(shown(t.select("product_id", "category", "mean_weight")), ["mean_weight"])


@query(
    "join_null_keys",
    f"""WITH {PRODUCTS_SQL}, l AS (SELECT product_id, CASE WHEN category = 'PROMO' THEN NULL ELSE category END AS k FROM products),
    r AS (SELECT CASE WHEN category = 'PROMO' THEN NULL ELSE category END AS k, count(*) AS n FROM products GROUP BY 1)
    SELECT product_id, l.k AS kind, n FROM l JOIN r ON l.k IS NOT DISTINCT FROM r.k""",
)
def join_null_keys(shop):
    kind = F.when(F.col("category") != "PROMO", F.col("category"))
    t = shop.products().with_columns({"kind": kind}).select("product_id", "kind")
    sizes = aggregate(t, "kind", dropna=False, n=("product_id", "count"))
    return join(t, sizes, on="kind", null_keys="match").untracked()
