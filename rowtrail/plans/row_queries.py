"""Sources, tokens, projection, selection, cleaning and time: operators that keep rows as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowtrail import Trail, aggregate, frequencies, join, register_operator
from rowtrail.features.encoding import DatetimeEncoder, TimestampParser
from rowtrail.functions import ids, time
from rowtrail.operators import lineage
from rowtrail.plans.registry import query, rounded, shown
from rowtrail.plans.shop import LINES_SQL, ORDERS_SQL, REVIEWS_SQL, SUMMARY_SQL, packed
from rowtrail.sources.readers import read_csv, sample_rows, write_csv
from rowtrail.sources.storage import shared_folder


@query(
    "src_ids",
    f"""WITH {LINES_SQL} SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, 1::BIGINT AS prov_n,
    'lineitem:' || rid AS prov FROM lines""",
)
def src_ids(shop):
    return shown(shop.lines().select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"))


@query(
    "src_two_names",
    f"""WITH {LINES_SQL}, e AS (SELECT l_orderkey AS order_id, {packed(0, 'rid')} AS pid FROM lines
      UNION ALL SELECT l_orderkey, {packed(1, 'rid')} FROM lines),
    n AS (SELECT l_orderkey AS order_id, count(*) AS n FROM lines GROUP BY 1)
    SELECT e.order_id, any_value(n.n) AS n, any_value(n.n) AS n_again, {SUMMARY_SQL}
    FROM e JOIN n ON e.order_id = n.order_id GROUP BY e.order_id""",
)
def src_two_names(shop):
    first = aggregate(shop.payments("payments"), "order_id", n=("installments", "count")).dealt(shop.tasks, "order_id")
    second = aggregate(shop.payments("order_payments"), "order_id", n_again=("installments", "count")).dealt(shop.tasks, "order_id")
    return lineage.with_summary(join(first, second, on="order_id"), ["order_id"])


@query(
    "src_csv",
    """SELECT o_orderkey, o_orderstatus, o_orderdate, 1::BIGINT AS prov_n,
    'orders_csv:' || o_orderkey AS prov FROM orders""",
)
def src_csv(shop):
    path = f"{shared_folder(shop.spark)}/orders-csv-{uuid.uuid4().hex}"
    write_csv(shop.table("orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), path)
    schema = "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp_ntz"
    return shown(shop.trail.source(read_csv(shop.spark, path, schema), "orders_csv", row_key="o_orderkey", unique=True))


@query(
    "src_sample",
    """SELECT o_orderkey, o_orderstatus, 1::BIGINT AS prov_n, 'orders:' || o_orderkey AS prov FROM orders
    WHERE ('0x' || substr(md5('7:' || o_orderkey), 1, 8))::BIGINT < CAST(floor(0.01 * 4294967296) AS BIGINT)""",
)
def src_sample(shop):
    df = sample_rows(shop.table("orders"), "o_orderkey", 0.01, seed=7)
    return shown(shop.trail.source(df, "orders", row_key="o_orderkey", unique=True).select("o_orderkey", "o_orderstatus"))


@query(
    "decode_tokens",
    """SELECT p_partkey, 'tab40000' || ':' || p_partkey AS token, 40000 AS table_id, p_partkey AS row_id FROM part""",
)
def decode_tokens(shop):
    # a table number above 32767 sets the sign bit of the packed id
    trail = Trail([f"tab{i}" for i in range(40_001)])
    t = trail.source(shop.table("part").select("p_partkey"), "tab40000", row_key="p_partkey", unique=True)
    pid = F.col(t.hidden[0])
    names = {40_000: trail.table_name(40_000)}
    return t.df.select(
        "p_partkey", ids.token(pid, names).alias("token"), ids.table_of(pid).alias("table_id"), ids.row_of(pid).alias("row_id")
    )


@query(
    "show_raw",
    f"""SELECT {packed(0, 'o_orderkey')} AS raw_orders, {packed(1, 'c_custkey')} AS raw_customer
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def show_raw(shop):
    orders, customer = shop.tracked("orders", "o_orderkey"), shop.tracked("customer", "c_custkey")
    raw = join(orders, customer, left_on="o_custkey", right_on="c_custkey").raw()
    return raw.toDF("raw_orders", "raw_customer")


@query(
    "prov_nonempty",
    "SELECT 0::BIGINT AS n_missing, (SELECT count(*) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) AS n_rows",
)
def prov_nonempty(shop):
    t = join(shop.tracked("orders", "o_orderkey"), shop.lines(), left_on="o_orderkey", right_on="l_orderkey", how="left")
    missing = lineage.rows_without_lineage(t).agg(F.count(F.lit(1)).alias("n_missing"))
    return t.df.agg(F.count(F.lit(1)).alias("n_rows")).select(missing.scalar().alias("n_missing"), "n_rows")


@query(
    "select_prov",
    """SELECT c_custkey AS customer_id, c_mktsegment AS state, 1::BIGINT AS prov_n,
    'customer:' || c_custkey AS prov FROM customer""",
)
def select_prov(shop):
    t = shop.tracked("customer", "c_custkey").drop("c_name", "c_acctbal")
    return shown(t.rename({"c_custkey": "customer_id", "c_mktsegment": "state"}).select("customer_id", "state"))


@query(
    "filter_prov",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority, 1::BIGINT AS prov_n, 'orders:' || o_orderkey AS prov
    FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 100 AND o_custkey <= 900 AND o_totalprice > 100000
    AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def filter_prov(shop):
    t = shop.tracked("orders", "o_orderkey").filter(F.col("o_orderstatus") == "F")
    t = t.filter(F.col("o_custkey").between(100, 900) & (F.col("o_totalprice") > 100000))
    t = t.where_in("o_orderpriority", ["1-URGENT", "2-HIGH"])
    return shown(t.select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query(
    "filter_membership",
    """SELECT o_orderkey, o_custkey, 1::BIGINT AS prov_n, 'orders:' || o_orderkey AS prov
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def filter_membership(shop):
    wanted = shop.table("customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return shown(shop.tracked("orders", "o_orderkey").where_in("o_custkey", wanted).select("o_orderkey", "o_custkey"))


@query(
    "assign_prov",
    f"""WITH {ORDERS_SQL} SELECT order_id, order_status, CAST(coalesce(delivered > estimated, false) AS INT) AS is_late,
    CAST(coalesce(strftime(delivered, '%Y-%m-%d') > strftime(estimated, '%Y-%m-%d'), false) AS INT) AS is_late_text,
    order_id AS order_copy, 1::BIGINT AS prov_n, 'orders:' || order_id AS prov FROM orders_r""",
)
def assign_prov(shop):
    t = shop.orders().with_columns(
        {
            "is_late": lambda d: time.flag(d["delivered"] > d["estimated"]),
            "is_late_text": time.flag(
                F.date_format("delivered", "yyyy-MM-dd") > F.date_format("estimated", "yyyy-MM-dd")
            ),
            "order_copy": F.col("order_id"),
        }
    )
    return shown(t.select("order_id", "order_status", "is_late", "is_late_text", "order_copy"))


@query(
    "clean_nulls",
    f"""WITH {ORDERS_SQL}, {REVIEWS_SQL},
    j AS (SELECT o.order_id, o.customer_id, review_score, purchase, delivered,
      CASE WHEN o.order_id % 11 = 0 THEN NULL ELSE o.customer_id / 7.0 END AS ratio
      FROM orders_r o LEFT JOIN reviews r ON o.order_id = r.order_id),
    g AS (SELECT avg(review_score) AS m FROM reviews)
    SELECT order_id, coalesce(review_score, 0) AS score_zero, coalesce(CAST(review_score AS VARCHAR), 'unknown') AS score_text,
      round(coalesce(CAST(review_score AS DOUBLE), (SELECT m FROM g)), 6) AS score_mean, round(ratio, 6) AS ratio,
      CAST(coalesce(review_score <= 2, false) AS INT) AS bad, 
      CASE WHEN review_score IS NULL THEN 1::BIGINT ELSE 2::BIGINT END AS prov_n,
      'orders:' || order_id || CASE WHEN review_score IS NULL THEN '' ELSE ',reviews:' || order_id END AS prov
    FROM j WHERE ratio IS NOT NULL AND delivered IS NOT NULL""",
)
def clean_nulls(shop):
    t = join(shop.orders(), shop.reviews(), on="order_id", how="left")
    ratio = F.when(F.col("order_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("customer_id") / 7.0)
    t = t.with_columns({"ratio": ratio}).infinite_to_null().drop_nulls(["ratio", "delivered"])
    score = F.col("review_score")
    t = t.with_columns(
        {"score_zero": score, "score_text": score.cast("string"), "score_mean": score.cast("double"), "bad": time.flag(score <= 2)}
    ).fill_nulls({"score_zero": 0, "score_text": "unknown"})
    t = t.fill_with_scalar("score_mean", shop.reviews().df.agg(F.avg("review_score")))
    return rounded(
        shown(t.select("order_id", "score_zero", "score_text", "score_mean", "ratio", "bad")), ["score_mean", "ratio"]
    )


@query(
    "first_per_key",
    f"""WITH {LINES_SQL} SELECT l_orderkey, l_partkey, l_quantity, 1::BIGINT AS prov_n, 'lineitem:' || rid AS prov
    FROM lines QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY rid) = 1""",
)
def first_per_key(shop):
    return shown(shop.lines().select("l_orderkey", "l_partkey", "l_quantity").first_per_key(["l_orderkey"]))


@query(
    "head_prov",
    f"""WITH {LINES_SQL} SELECT l_orderkey, l_partkey, 1::BIGINT AS prov_n, 'lineitem:' || rid AS prov
    FROM lines WHERE l_quantity > 25 ORDER BY rid LIMIT 10""",
)
def head_prov(shop):
    return shown(shop.lines().filter("l_quantity > 25").select("l_orderkey", "l_partkey").head(10))


@query(
    "freq_table",
    f"""SELECT o_orderpriority, count(*) AS n, {SUMMARY_SQL} FROM (SELECT *, {packed(0, 'o_orderkey')} AS pid FROM orders)
    GROUP BY o_orderpriority""",
)
def freq_table(shop):
    t = frequencies(shop.tracked("orders", "o_orderkey"), "o_orderpriority", "n")
    return lineage.with_summary(t, ["o_orderpriority"])


@query(
    "user_operator",
    """SELECT o_orderkey, o_totalprice, 1::BIGINT AS prov_n, 'orders:' || o_orderkey AS prov FROM orders
    WHERE o_totalprice > 400000""",
)
def user_operator(shop):
    register_operator("above", lambda t, column, limit: t.filter(F.col(column) > limit))
    t = shop.tracked("orders", "o_orderkey").select("o_orderkey", "o_totalprice")
    return shown(t.apply("above", "o_totalprice", 400000))


@query(
    "ts_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS parsed,
    1::BIGINT AS prov_n, 'orders:' || o_orderkey AS prov FROM orders""",
)
def ts_parse(shop):
    raw = F.when(F.col("o_orderkey") % 13 == 0, F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    t = shop.tracked("orders", "o_orderkey").with_columns({"parsed": raw}).select("o_orderkey", "parsed")
    t = TimestampParser(["parsed"]).fit(t).transform(t)
    return shown(t.with_columns({"parsed": F.col("parsed").cast("timestamp_ntz")}))


@query(
    "delay_days",
    f"""WITH {ORDERS_SQL}, e AS (SELECT order_id, delivered, estimated + INTERVAL (order_id % 24) HOUR AS due FROM orders_r)
    SELECT order_id, CAST(floor(date_diff('microsecond', due, delivered) / 86400000000.0) AS BIGINT) AS days,
    round(date_diff('microsecond', due, delivered) / 86400000000.0, 6) AS days_exact,
    1::BIGINT AS prov_n, 'orders:' || order_id AS prov FROM e""",
)
def delay_days(shop):
    t = shop.orders().with_columns(
        {"due": F.expr("estimated + make_dt_interval(0, cast(order_id % 24 as int), 0, 0)")}
    )
    t = t.with_columns(
        {
            "days": time.whole_days(F.col("delivered"), F.col("due")),
            "days_exact": time.fractional_days(F.col("delivered"), F.col("due")),
        }
    )
    return rounded(shown(t.select("order_id", "days", "days_exact")), ["days_exact"])


@query(
    "dt_parts",
    """SELECT event_id, CAST(year(ts) AS INT) AS ts_year, CAST(month(ts) AS INT) AS ts_month, CAST(day(ts) AS INT) AS ts_day,
    CAST(hour(ts) AS INT) AS ts_hour, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS ts_total_seconds,
    1::BIGINT AS prov_n, 'events:' || event_id AS prov FROM events""",
)
def dt_parts(shop):
    t = shop.tracked("events", "event_id").select("event_id", "ts")
    return shown(DatetimeEncoder(["ts"]).fit(t).transform(t))
