"""Aggregates: all forms of a specification, re-aggregation, reducers, joined text, Python functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rowtrail import aggregate, join
from rowtrail.operators import lineage
from rowtrail.operators.text_join import aggregate_python, text_parts
from rowtrail.plans.registry import query, rounded
from rowtrail.plans.shop import (
    GEO_SQL, ITEMS_SQL, LINES_SQL, ORDERS_SQL, PAYMENTS_SQL, PRODUCTS_SQL, SUMMARY_SQL, packed,
)

PRODUCT_SUMMARY = f"FROM (SELECT *, {packed(0, 'product_id')} AS pid FROM products)"


@query(
    "agg_dict",
    f"""WITH {PRODUCTS_SQL} SELECT category, CAST(sum(weight) AS BIGINT) AS weight, min(product_name) AS product_name, {SUMMARY_SQL}
    {PRODUCT_SUMMARY} GROUP BY category""",
)
def agg_dict(shop):
    t = aggregate(shop.products(), "category", {"weight": "sum", "product_name": "min"})
    return lineage.with_summary(t, ["category"])


@query(
    "agg_named",
    f"""WITH {LINES_SQL}, {PAYMENTS_SQL} SELECT order_id, CAST(sum(payment_cents) AS BIGINT) AS total_cents, count(payment_cents) AS n_payments,
    max(installments) AS max_installments, min(installments) AS min_installments, round(avg(installments), 6) AS mean_installments,
    count(DISTINCT payment_type) AS type_count, {SUMMARY_SQL} FROM (SELECT *, {packed(0, 'rid')} AS pid FROM payments) GROUP BY order_id""",
)
def agg_named(shop):
    t = aggregate(
        shop.payments(), "order_id",
        total_cents=("payment_cents", "sum"), n_payments=("payment_cents", "count"),
        max_installments=("installments", "max"), min_installments=("installments", "min"),
        mean_installments=("installments", "mean"), type_count=("payment_type", "nunique"),
    )
    return rounded(lineage.with_summary(t, ["order_id"]), ["mean_installments"])


@query(
    "agg_string",
    f"""WITH {PRODUCTS_SQL} SELECT brand, CAST(sum(product_id) AS BIGINT) AS product_id, CAST(sum(weight) AS BIGINT) AS weight, {SUMMARY_SQL}
    {PRODUCT_SUMMARY} GROUP BY brand""",
)
def agg_string(shop):
    t = aggregate(shop.products().select("brand", "product_id", "weight"), "brand", "sum")
    return lineage.with_summary(t, ["brand"])


@query(
    "agg_list",
    f"""WITH {PRODUCTS_SQL} SELECT brand, CAST(sum(product_id) AS BIGINT) AS product_id_sum, max(product_id) AS product_id_max,
    CAST(sum(weight) AS BIGINT) AS weight_sum, max(weight) AS weight_max, {SUMMARY_SQL} {PRODUCT_SUMMARY} GROUP BY brand""",
)
def agg_list(shop):
    t = aggregate(shop.products().select("brand", "product_id", "weight"), "brand", ["sum", "max"])
    return lineage.with_summary(t, ["brand"])


@query(
    "agg_global",
    f"""WITH {LINES_SQL}, {PAYMENTS_SQL} SELECT CAST(sum(payment_cents) AS BIGINT) AS total, count(DISTINCT order_id) AS n_orders,
    round(avg(installments), 6) AS mean_installments, {SUMMARY_SQL} FROM (SELECT *, {packed(0, 'rid')} AS pid FROM payments)""",
)
def agg_global(shop):
    t = aggregate(
        shop.payments(), (), total=("payment_cents", "sum"), n_orders=("order_id", "nunique"), mean_installments=("installments", "mean")
    )
    sizes = lineage.summary(t, [])
    both = t.untracked().select("*", *[sizes.select(c).scalar().alias(c) for c in sizes.columns])
    return rounded(both, ["mean_installments"])


@query(
    "agg_one_column",
    f"""WITH {LINES_SQL} SELECT max(l_quantity) AS l_quantity, (SELECT count(*) FROM lines) AS prov_n FROM lines""",
)
def agg_one_column(shop):
    t = aggregate(shop.lines().select("l_quantity"), (), "max")
    return t.untracked().select("l_quantity", lineage.summary(t, []).select("prov_n").scalar().alias("prov_n"))


@query(
    "agg_lineage_only",
    f"""WITH {LINES_SQL} SELECT l_returnflag, l_linestatus, {SUMMARY_SQL} FROM (SELECT *, {packed(0, 'rid')} AS pid FROM lines)
    GROUP BY l_returnflag, l_linestatus""",
)
def agg_lineage_only(shop):
    # few groups, each a large share of the table: counted and combined without any array
    t = aggregate(shop.lines(), ["l_returnflag", "l_linestatus"])
    return lineage.with_summary(t, ["l_returnflag", "l_linestatus"])


@query(
    "agg_of_agg",
    f"""WITH {LINES_SQL}, {ITEMS_SQL}, a AS (SELECT order_id, CAST(sum(price_cents) AS BIGINT) AS total FROM items GROUP BY order_id),
    o AS (SELECT o_custkey AS customer_id, o_orderkey AS order_id, coalesce(total, 0) AS total FROM orders LEFT JOIN a ON order_id = o_orderkey),
    e AS (SELECT o_custkey AS customer_id, {packed(0, 'o_orderkey')} AS pid FROM orders
      UNION ALL SELECT o_custkey, {packed(1, 'rid')} FROM orders JOIN items ON order_id = o_orderkey),
    s AS (SELECT customer_id, {SUMMARY_SQL} FROM e GROUP BY customer_id)
    SELECT o.customer_id, count(order_id) AS n_orders, CAST(sum(total) AS BIGINT) AS total, round(avg(total), 6) AS mean_total,
    any_value(prov_n) AS prov_n, any_value(prov_min) AS prov_min, any_value(prov_max) AS prov_max, any_value(prov_xor) AS prov_xor
    FROM o JOIN s ON s.customer_id = o.customer_id GROUP BY o.customer_id""",
)
def agg_of_agg(shop):
    orders = shop.tracked("orders", "o_orderkey").rename({"o_orderkey": "order_id", "o_custkey": "customer_id"})
    items = aggregate(shop.order_items(), "order_id", total=("price_cents", "sum"))
    t = join(orders.select("order_id", "customer_id"), items, on="order_id", how="left").fill_nulls({"total": 0})
    t = aggregate(t, "customer_id", n_orders=("order_id", "count"), total=("total", "sum"), mean_total=("total", "mean"))
    return rounded(lineage.with_summary(t, ["customer_id"]), ["mean_total"])


@query(
    "agg_reducer_set",
    f"""WITH {LINES_SQL}, {PRODUCTS_SQL}, j AS (SELECT l_orderkey, category, rid, product_id FROM lines JOIN products ON product_id = l_partkey),
    e AS (SELECT l_orderkey, {packed(0, 'rid')} AS pid FROM j UNION SELECT l_orderkey, {packed(1, 'product_id')} FROM j)
    SELECT l_orderkey, (pid >> 48)::INT AS table_id, pid & 281474976710655 AS row_id FROM e""",
)
def agg_reducer_set(shop):
    return lineage.edges(_order_products(shop), ["l_orderkey"])


@query(
    "agg_reducer_bag",
    f"""WITH {LINES_SQL}, {PRODUCTS_SQL}, j AS (SELECT l_orderkey, category, rid, product_id FROM lines JOIN products ON product_id = l_partkey),
    e AS (SELECT l_orderkey, {packed(0, 'rid')} AS pid FROM j UNION ALL SELECT l_orderkey, {packed(1, 'product_id')} FROM j)
    SELECT l_orderkey, (pid >> 48)::INT AS table_id, pid & 281474976710655 AS row_id, count(*) AS times FROM e GROUP BY l_orderkey, pid""",
)
def agg_reducer_bag(shop):
    return lineage.edges(_order_products(shop), ["l_orderkey"], bag=True)


def _order_products(shop):
    t = join(shop.lines(), shop.products(), left_on="l_partkey", right_on="product_id")
    return aggregate(t, "l_orderkey", n=("category", "count"))


@query(
    "agg_concat",
    f"""WITH {LINES_SQL}, {PAYMENTS_SQL}, t AS (SELECT order_id, string_agg(payment_type, ' ' ORDER BY rid) AS payment_types,
    coalesce(string_agg(CASE WHEN installments <> 3 THEN 'i' || installments END, ' ' ORDER BY rid), '') AS others FROM payments GROUP BY order_id)
    SELECT order_id, 0::BIGINT AS part, payment_types, others FROM t""",
)
def agg_concat(shop):
    payments = shop.payments().with_columns(
        {"other": F.when(F.col("installments") != 3, F.concat(F.lit("i"), F.col("installments").cast("string")))}
    )
    return text_parts(payments, ["order_id"], {"payment_types": "payment_type", "others": "other"}).withColumnRenamed("_part", "part")


@query(
    "agg_multi_key",
    f"""WITH {GEO_SQL}, k AS (SELECT gid, lat, lng, geo_zip, city, CASE WHEN region = 'ASIA' THEN NULL ELSE region END AS region FROM geo)
    SELECT geo_zip, city, region, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, {SUMMARY_SQL}
    FROM (SELECT *, {packed(0, 'gid')} AS pid FROM k) GROUP BY geo_zip, city, region""",
)
def agg_multi_key(shop):
    geo = shop.geolocation().with_columns({"region": F.when(F.col("region") != "ASIA", F.col("region"))})
    keys = ["geo_zip", "city", "region"]
    t = aggregate(geo, keys, {"lat": "mean", "lng": "mean"}, dropna=False)
    return rounded(lineage.with_summary(t, keys), ["lat", "lng"])


@query(
    "agg_drop_null_keys",
    f"""WITH {GEO_SQL} SELECT region, count(*) AS n, {SUMMARY_SQL} FROM (SELECT *, {packed(0, 'gid')} AS pid FROM geo)
    WHERE region <> 'ASIA' GROUP BY region""",
)
def agg_drop_null_keys(shop):
    geo = shop.geolocation().with_columns({"region": F.when(F.col("region") != "ASIA", F.col("region"))})
    return lineage.with_summary(aggregate(geo, "region", n=("geo_zip", "count")), ["region"])


@query(
    "agg_callable",
    f"""WITH {LINES_SQL}, {PAYMENTS_SQL} SELECT payment_type, round(count(*) / sum(1 / payment_value), 6) AS harmonic,
    {SUMMARY_SQL} FROM (SELECT *, {packed(0, 'rid')} AS pid FROM payments) GROUP BY payment_type""",
)
def agg_callable(shop):
    def partial(values: pd.Series) -> list:
        return [float(len(values)), float((1 / values).sum())]

    def merge(states: pd.Series) -> float:
        n, inverse = (sum(s[i] for s in states) for i in (0, 1))
        return n / inverse

    t = aggregate_python(shop.payments(), ["payment_type"], "payment_value", "harmonic", partial, merge)
    return rounded(lineage.with_summary(t, ["payment_type"]), ["harmonic"])


@query(
    "agg_spark_function",
    f"""WITH {PRODUCTS_SQL} SELECT brand, round(stddev_samp(weight), 6) AS spread, {SUMMARY_SQL} {PRODUCT_SUMMARY} GROUP BY brand""",
)
def agg_spark_function(shop):
    t = aggregate(shop.products(), "brand", spread=("weight", F.stddev_samp))
    return rounded(lineage.with_summary(t, ["brand"]), ["spread"])


@query(
    "agg_late_share",
    f"""WITH {ORDERS_SQL} SELECT order_status, count(*) AS n, round(avg(CAST(coalesce(delivered > estimated, false) AS INT)), 6) AS late_share,
    {SUMMARY_SQL} FROM (SELECT *, {packed(0, 'order_id')} AS pid FROM orders_r) GROUP BY order_status""",
)
def agg_late_share(shop):
    orders = shop.orders().with_columns({"late": F.coalesce(F.col("delivered") > F.col("estimated"), F.lit(False)).cast("int")})
    t = aggregate(orders, "order_status", n=("order_id", "count"), late_share=("late", "mean"))
    return rounded(lineage.with_summary(t, ["order_status"]), ["late_share"])
