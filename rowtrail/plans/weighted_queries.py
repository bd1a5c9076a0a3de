"""Joins with the nearest row by weighted n-grams and by numbers, beside brute force in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtrail.operators.weighted import weighted_join
from rowtrail.plans.fuzzy_queries import TYPOS
from rowtrail.plans.registry import query, rounded, shown


def nearest_sql(left: str, right: str, texts: list[str], numbers: list[str], max_distance: float | None = None) -> str:
    """CTEs up to ``nearest`` (l_…, r_…, distance) over the distinct keys of two SELECTs."""
    names = [*texts, *numbers]
    keys = ", ".join(names)

    def grams(side: str) -> str:
        parts = " UNION ALL ".join(
            f"SELECT id, {i} AS c, substr(' ' || w || ' ', i, n) AS g FROM (SELECT id, unnest(string_split_regex(lower({t}), '\\s+')) AS w FROM {side}), "
            f"(SELECT unnest(range(2, 5)) AS n), LATERAL (SELECT unnest(range(1, length(w) + 4 - n)) AS i) WHERE w <> ''"
            for i, t in enumerate(texts)
        )
        return f"{side}_tf AS (SELECT id, c, g, count(*) AS tf FROM ({parts}) GROUP BY ALL)"

    def weighed(side: str) -> str:
        return (
            f"{side}_w AS (SELECT id, c, g, x / sqrt(sum(x * x) OVER (PARTITION BY id, c)) AS w FROM (SELECT t.id, t.c, t.g, "
            f"tf * (ln((1.0 + (SELECT count(*) FROM rk)) / (1 + coalesce(df, 0))) + 1) AS x FROM {side}_tf t LEFT JOIN gram_df d ON d.c = t.c AND d.g = t.g))"
        )

    order = ", ".join(f"{k} NULLS FIRST" for k in names)
    some = " OR ".join(f"{k} IS NOT NULL" for k in names)
    parts = [
        f"{side} AS (SELECT *, row_number() OVER (ORDER BY {order}) AS id FROM (SELECT DISTINCT {keys} FROM ({sql})) WHERE {some})" for side, sql in (("lk", left), ("rk", right))
    ]
    dot = "0.0"
    if texts:
        parts += [grams("lk"), grams("rk"), "gram_df AS (SELECT c, g, count(*) AS df FROM rk_tf GROUP BY c, g)", weighed("lk"), weighed("rk")]
        parts.append("dots AS (SELECT l.id AS lid, r.id AS rid, sum(l.w * r.w) AS dot FROM lk_w l JOIN rk_w r ON r.c = l.c AND r.g = l.g GROUP BY l.id, r.id)")
        dot = "coalesce(dot, 0)"
    scaled = " + ".join(
        f"pow(coalesce((l.{c} - (SELECT avg({c}) FROM rk)) / z{i}, 0) - coalesce((r.{c} - (SELECT avg({c}) FROM rk)) / z{i}, 0), 2)" for i, c in enumerate(numbers)
    )
    spreads = ", ".join(f"CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS z{i}" for i, c in enumerate(numbers)) or "1 AS z"
    same = " AND ".join(f"l.{k} IS NOT DISTINCT FROM r.{k}" for k in names)
    parts.append(
        f"""pairs AS (SELECT l.id AS lid, r.id AS rid, {same} AS same,
        CASE WHEN {same} THEN 0 ELSE round(greatest({2.0 * len(texts)} - 2 * {dot}, 0), 9) + round({scaled or 0.0}, 12) END AS d2
        FROM lk l CROSS JOIN rk r CROSS JOIN (SELECT {spreads} FROM rk) {'LEFT JOIN dots ON lid = l.id AND rid = r.id' if texts else ''})"""
    )
    limit = "" if max_distance is None else f"WHERE d2 <= {max_distance ** 2 + 1e-9}"
    parts.append(
        f"""nearest AS (SELECT {", ".join(f"l.{k} AS l_{k}, r.{k} AS r_{k}" for k in names)}, sqrt(d2) AS distance FROM
        (SELECT * FROM pairs {limit} QUALIFY row_number() OVER (PARTITION BY lid ORDER BY d2, same DESC, rid) = 1) JOIN lk l ON l.id = lid JOIN rk r ON r.id = rid)"""
    )
    return ", ".join(parts)


NAMES_SQL = f"""WITH aux AS (SELECT p_partkey AS aux_id, {TYPOS} AS aux_name FROM part),
    {nearest_sql('SELECT p_name AS k0 FROM part', 'SELECT aux_name AS k0 FROM aux', ['k0'], [])},
    first AS (SELECT * FROM aux QUALIFY row_number() OVER (PARTITION BY aux_name ORDER BY aux_id) = 1)
    SELECT p_partkey, p_name, aux_id, aux_name, round(distance, 4) AS match_distance, distance IS NOT NULL AS match_accepted,
    1 + CAST(aux_id IS NOT NULL AS BIGINT) AS prov_n, 'part:' || p_partkey || coalesce(',aux:' || aux_id, '') AS prov
    FROM part LEFT JOIN nearest ON l_k0 = p_name LEFT JOIN first ON aux_name = r_k0"""


def names_joined(shop, **how):
    part = shop.tracked("part", "p_partkey").select("p_partkey", "p_name")
    aux = shop.table("part").select(F.col("p_partkey").alias("aux_id"), F.expr(TYPOS).alias("aux_name"))
    t = weighted_join(part, shop.trail.source(aux, "aux", row_key="aux_id", unique=True), "p_name", "aux_name", match_info=True, **how)
    return rounded(shown(t), ["match_distance"], 4)


@query("weighted_join", NAMES_SQL)
def names_weighted(shop):
    """Part names and the same catalogue written with typos."""
    return names_joined(shop)


@query("weighted_join_rounds", NAMES_SQL)
def names_in_rounds(shop):
    """The same in rounds of growing radius, as for joins that are too large to add all products up."""
    return names_joined(shop, small_meetings=0)


SIMILAR_SQL = f"""WITH {nearest_sql('SELECT s_name AS k0 FROM supplier', 'SELECT c_name AS k0 FROM customer', ['k0'], [], 0.9)}
    SELECT s_suppkey, s_name, c_name, round(distance, 4) AS match_distance, 1 + CAST(c_custkey IS NOT NULL AS BIGINT) AS prov_n,
    'supplier:' || s_suppkey || coalesce(',customer:' || c_custkey, '') AS prov
    FROM supplier LEFT JOIN nearest ON l_k0 = s_name LEFT JOIN customer ON c_name = r_k0"""


@query("weighted_similar_keys", SIMILAR_SQL)
def weighted_similar_keys(shop):
    """Names that share most of their grams with all others, within a distance of 0.9."""
    t = weighted_join(
        shop.tracked("supplier", "s_suppkey").select("s_suppkey", "s_name"), shop.tracked("customer", "c_custkey").select("c_name"),
        "s_name", "c_name", max_distance=0.9, match_info=True, small_meetings=0,
    )
    return rounded(shown(t.drop("match_accepted")), ["match_distance"], 4)


SELLERS = "SELECT lower(n_name) AS k0, s_acctbal AS k1 FROM supplier JOIN nation ON n_nationkey = s_nationkey"
BUYERS = "SELECT CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE replace(n_name, 'A', 'E') END AS k0, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS k1"


@query(
    "mixed_join",
    f"""WITH {nearest_sql(BUYERS + " FROM customer JOIN nation ON n_nationkey = c_nationkey", SELLERS, ['k0'], ['k1'])},
    buyers AS (SELECT c_custkey, b.* FROM (SELECT c_custkey, {BUYERS[7:]} FROM customer JOIN nation ON n_nationkey = c_nationkey) b),
    sellers AS (SELECT s_suppkey, lower(n_name) AS city, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey
      QUALIFY row_number() OVER (PARTITION BY lower(n_name), s_acctbal ORDER BY s_suppkey) = 1)
    SELECT c_custkey, s_suppkey, city, round(distance, 4) AS match_distance, 2::BIGINT AS prov_n, 'customer:' || c_custkey || ',supplier:' || s_suppkey AS prov
    FROM buyers JOIN nearest ON l_k0 = k0 AND l_k1 IS NOT DISTINCT FROM k1 JOIN sellers ON city = r_k0 AND s_acctbal = r_k1""",
)
def mixed_join(shop):
    """Customers with the supplier nearest by the name of the place, written in another way or not at all, and by balance, missing for some."""
    nation = shop.table("nation").select("n_nationkey", "n_name")
    buyers = shop.table("customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    place = F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise(F.replace("n_name", F.lit("A"), F.lit("E")))
    buyers = buyers.select("c_custkey", place.alias("place"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"))
    sellers = shop.table("supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.lower("n_name").alias("city"), "s_acctbal")
    t = weighted_join(
        shop.trail.source(buyers, "customer", row_key="c_custkey", unique=True), shop.trail.source(sellers, "supplier", row_key="s_suppkey", unique=True),
        ["place", "balance"], ["city", "s_acctbal"], match_info=True,
    )
    return rounded(shown(t.select("c_custkey", "s_suppkey", "city", "match_distance")), ["match_distance"], 4)


@query(
    "nearest_numbers",
    f"""WITH {nearest_sql('SELECT CAST(c_nationkey AS DOUBLE) AS k0, c_acctbal AS k1 FROM customer', 'SELECT CAST(s_nationkey AS DOUBLE) AS k0, s_acctbal AS k1 FROM supplier', [], ['k0', 'k1'])},
    first AS (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey, s_acctbal ORDER BY s_suppkey) = 1)
    SELECT c_custkey, s_suppkey, round(distance, 4) AS match_distance, 2::BIGINT AS prov_n, 'customer:' || c_custkey || ',supplier:' || s_suppkey AS prov
    FROM customer JOIN nearest ON l_k0 = c_nationkey AND l_k1 = c_acctbal JOIN first ON s_nationkey = r_k0 AND s_acctbal = r_k1""",
)
def nearest_numbers(shop):
    """Customers with the supplier nearest by two numbers."""
    t = weighted_join(
        shop.tracked("customer", "c_custkey").select("c_custkey", "c_nationkey", "c_acctbal"),
        shop.tracked("supplier", "s_suppkey").select("s_suppkey", "s_nationkey", "s_acctbal"),
        ["c_nationkey", "c_acctbal"], ["s_nationkey", "s_acctbal"], match_info=True, small_meetings=2000,
    )
    return rounded(shown(t.select("c_custkey", "s_suppkey", "match_distance")), ["match_distance"], 4)
