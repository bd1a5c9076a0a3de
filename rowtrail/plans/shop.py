"""The roles of an e-commerce data set over the given tables.

orders, customers, products, suppliers and events have keys that count from 0, so the key is the row id.
lineitem has no key: its row id is its place in the order of all its columns, assigned once per session and
folder and kept as a table in the shared folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrail.operators.tracked import Tracked
from rowtrail.sources.numbering import number_rows
from rowtrail.sources.readers import read_table
from rowtrail.sources.storage import store
from rowtrail.sources.trail import Trail

LINE_ORDER = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
ESTIMATED_DAYS = 720
LINES_PER_TASK = 500_000

_numbered: dict[tuple[str, str], DataFrame] = {}


class Shop:
    """Readers of the given tables and tracked frames of the roles, all in one trail."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.trail = spark, folder, Trail()

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def tracked(self, name: str, key: str, as_name: str | None = None) -> Tracked:
        """A table whose ``key`` counts its rows from 0."""
        return self.trail.source(self.table(name), as_name or name, row_key=key, unique=True)

    @cached_property
    def numbered_lines(self) -> DataFrame:
        """lineitem with its row number ``line_row``."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _numbered:
            _numbered[key] = store(number_rows(self.table("lineitem"), LINE_ORDER, "line_row"), "lineitem")
        return _numbered[key]

    @cached_property
    def tasks(self) -> int:
        """Tasks in which groups of lines meet, so that none holds more than about ``LINES_PER_TASK`` lines' groups at any size."""
        known = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(known, -(-self.numbered_lines.count() // LINES_PER_TASK))

    def lines(self, as_name: str = "lineitem") -> Tracked:
        return self.trail.source(self.numbered_lines, as_name, row_key="line_row", numbered=True).drop("line_row")

    def documents(self) -> Tracked:
        return self.trail.source(self.table("documents"), "documents", row_key="doc_id", unique=True)

    # -- roles ---------------------------------------------------------------------------------------

    def customers(self) -> Tracked:
        """customer_id, zip, state."""
        df = self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_nationkey").cast("long").alias("zip"),
            F.col("c_mktsegment").alias("state"),
        )
        return self.trail.source(df, "customers", row_key="customer_id", unique=True)

    def orders(self, as_name: str = "orders") -> Tracked:
        """order_id, customer_id, order_status, purchase, estimated, delivered (NULL without lines)."""
        delivered = self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.max("l_shipdate").alias("delivered")
        )
        df = self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("purchase"),
            (F.col("o_orderdate") + F.expr(f"INTERVAL {ESTIMATED_DAYS} DAYS")).alias("estimated"),
        )
        return self.trail.source(df.join(delivered, "order_id", "left"), as_name, row_key="order_id", unique=True)

    def order_items(self, as_name: str = "order_items") -> Tracked:
        """order_id, item_id, product_id, price and freight; money in whole cents too; item_row, the row number."""
        df = self.numbered_lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").cast("long").alias("item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight"),
            cents("l_extendedprice").alias("price_cents"),
            cents("l_extendedprice * l_tax").alias("freight_cents"),
            F.col("line_row").alias("item_row"),
        )
        return self.trail.source(df, as_name, row_key="item_row", numbered=True)

    def payments(self, as_name: str = "payments") -> Tracked:
        """order_id, payment_type, installments, payment_value; the value in whole cents too."""
        df = self.numbered_lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_returnflag").alias("payment_type"),
            F.col("l_linenumber").cast("long").alias("installments"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("payment_value"),
            cents("l_extendedprice * (1 - l_discount)").alias("payment_cents"),
            F.col("l_shipdate").alias("paid"),
            "line_row",
        )
        return self.trail.source(df, as_name, row_key="line_row", numbered=True).drop("line_row")

    def order_payments(self) -> Tracked:
        """order_id, payment_type, installments, payment_cents: the one payment of each order."""
        df = self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderpriority").alias("payment_type"),
            (1 + F.col("o_orderkey") % 6).alias("installments"),
            cents("o_totalprice").alias("payment_cents"),
        )
        return self.trail.source(df, "payments", row_key="order_id", unique=True)

    def reviews(self) -> Tracked:
        """order_id, review_score 1 to 5; every seventh review names an order that is not there."""
        key = F.col("o_orderkey")
        df = self.table("orders").select(
            F.when(key % 7 == 0, -1 - key).otherwise(key).alias("order_id"), (1 + key % 5).alias("review_score"), key.alias("review_row")
        )
        return self.trail.source(df, "reviews", row_key="review_row", unique=True).drop("review_row")

    def products(self) -> Tracked:
        """product_id, category, brand, weight, product_name."""
        df = self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("p_size").cast("long").alias("weight"),
            F.col("p_name").alias("product_name"),
        )
        return self.trail.source(df, "products", row_key="product_id", unique=True)

    def translations(self) -> Tracked:
        """category, category_en, numbered by category; the last category of the alphabet is misspelt and finds no product."""
        kinds = self.table("part").select(F.col("p_type").alias("category")).distinct()
        last = kinds.agg(F.max("category"))
        named = kinds.withColumn("category_en", F.lower("category"))
        misspelt = F.concat("category", F.lit("?"))
        named = named.withColumn("category", F.when(F.col("category") == last.scalar(), misspelt).otherwise(F.col("category")))
        return self.trail.source(named, "translations", order_by=["category"])

    def geolocation(self) -> Tracked:
        """zip, lat, lng, city, region; one row per supplier, many per zip."""
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        df = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(
            r, F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            F.col("s_suppkey").alias("geo_id"),
            F.col("s_nationkey").cast("long").alias("geo_zip"),
            F.col("s_acctbal").alias("lat"),
            F.col("s_suppkey").cast("double").alias("lng"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("region"),
        )
        return self.trail.source(df, "geolocation", row_key="geo_id", unique=True).drop("geo_id")


def cents(expression: str):
    return F.round(F.expr(expression) * 100).cast("long")


# -- the same roles for the SQL side -------------------------------------------------------------------

LINES_SQL = f"lines AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS rid FROM lineitem)"
ORDERS_SQL = f"""orders_r AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
  o_orderdate AS purchase, o_orderdate + INTERVAL {ESTIMATED_DAYS} DAY AS estimated, delivered
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY l_orderkey) d
  ON l_orderkey = o_orderkey)"""
ITEMS_SQL = """items AS (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS item_id, l_partkey AS product_id,
  l_extendedprice AS price, l_extendedprice * l_tax AS freight,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
  CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) AS freight_cents, rid FROM lines)"""
PAYMENTS_SQL = """payments AS (SELECT l_orderkey AS order_id, l_returnflag AS payment_type,
  CAST(l_linenumber AS BIGINT) AS installments, l_extendedprice * (1 - l_discount) AS payment_value,
  CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS payment_cents, l_shipdate AS paid, rid FROM lines)"""
ORDER_PAYMENTS_SQL = """order_payments AS (SELECT o_orderkey AS order_id, o_orderpriority AS payment_type,
  1 + o_orderkey % 6 AS installments, CAST(round(o_totalprice * 100) AS BIGINT) AS payment_cents FROM orders)"""
REVIEWS_SQL = """reviews AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS order_id,
  1 + o_orderkey % 5 AS review_score FROM orders)"""
CUSTOMERS_SQL = """customers AS (SELECT c_custkey AS customer_id, CAST(c_nationkey AS BIGINT) AS zip,
  c_mktsegment AS state FROM customer)"""
PRODUCTS_SQL = """products AS (SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand,
  CAST(p_size AS BIGINT) AS weight, p_name AS product_name FROM part)"""
TRANSLATIONS_SQL = """translations AS (SELECT category || CASE WHEN category = (SELECT max(p_type) FROM part) THEN '?' ELSE '' END AS category,
  lower(category) AS category_en, row_number() OVER (ORDER BY category) - 1 AS trid FROM (SELECT DISTINCT p_type AS category FROM part))"""
GEO_SQL = """geo AS (SELECT s_suppkey AS gid, CAST(s_nationkey AS BIGINT) AS geo_zip, s_acctbal AS lat,
  CAST(s_suppkey AS DOUBLE) AS lng, n_name AS city, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
geo_first AS (SELECT * FROM geo QUALIFY row_number() OVER (PARTITION BY geo_zip ORDER BY gid) = 1)"""


def packed(table_id: int, row: str) -> str:
    """SQL for a packed id."""
    return f"(({table_id}::BIGINT << 48) | ({row}))"


SUMMARY_SQL = (
    "count(*) AS prov_n, min(pid) AS prov_min, max(pid) AS prov_max, bit_xor(pid) AS prov_xor"
)
