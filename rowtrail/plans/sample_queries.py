"""Row-making transformers: classes balanced by copies and by rows made between neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail.operators import oversample
from rowtrail.plans.registry import query, shown

SIZES_SQL = """n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), need AS (SELECT *, (SELECT max(n) FROM n) - n AS need FROM n),
  j AS (SELECT *, unnest(range(need)) AS j FROM need)"""


@query(
    "copy_sample",
    f"""WITH {SIZES_SQL}, r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
      ORDER BY ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::BIGINT, CAST(o_orderkey AS VARCHAR)) - 1 AS r FROM orders),
    a AS (SELECT o_orderkey, r.o_orderstatus, j // n + 1 AS made FROM j JOIN r ON r.o_orderstatus = j.o_orderstatus AND r = j % n
      UNION ALL SELECT o_orderkey, o_orderstatus, 0 FROM orders)
    SELECT *, 1::BIGINT AS prov_n, 'orders:' || o_orderkey AS prov FROM a""",
)
def copy_sample(shop):
    t = shop.tracked("orders", "o_orderkey").select("o_orderkey", "o_orderstatus")
    return shown(oversample.copy_sample(t, "o_orderstatus", key="o_orderkey"))


@query(
    "neighbour_sample",
    f"""WITH {SIZES_SQL}, r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus, o_totalprice, CAST(o_orderkey AS VARCHAR)) - 1 AS p FROM orders),
    f AS (SELECT o_orderstatus, min(p) AS f FROM r GROUP BY 1),
    m AS (SELECT f + j % n AS p, f + (j % n + (j // n) % least(5, greatest(n - 1, 1)) + 1) % n AS q, j + 1 AS made FROM j JOIN f USING (o_orderstatus)),
    a AS (SELECT a.o_orderkey, a.o_orderstatus, made, a.o_totalprice + (b.o_totalprice - a.o_totalprice)
        * (('0x' || substr(md5('0:' || m.p || ':' || m.q || ':' || made), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS x, a.o_orderkey AS k, b.o_orderkey AS l
      FROM m JOIN r a ON a.p = m.p JOIN r b ON b.p = m.q
      UNION ALL SELECT o_orderkey, o_orderstatus, 0, o_totalprice, o_orderkey, NULL FROM orders)
    SELECT o_orderkey, o_orderstatus, round(x, 4) AS o_totalprice, made, CASE WHEN l IS NULL OR l = k THEN 1 ELSE 2 END::BIGINT AS prov_n,
      CASE WHEN l IS NULL OR l = k THEN 'orders:' || k ELSE 'orders:' || least(k, l) || ',orders:' || greatest(k, l) END AS prov FROM a""",
)
def neighbour_sample(shop):
    t = shop.tracked("orders", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")
    made = oversample.neighbour_sample(t, "o_orderstatus", ["o_totalprice"], key="o_orderkey")
    return shown(made.with_columns({"o_totalprice": lambda df: F.round(df["o_totalprice"], 4)}))
