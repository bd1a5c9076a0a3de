"""Transformers, encoders, splits, models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rowtrail.features.base import Branches, Chain
from rowtrail.features.encoding import (
    GapEncoder, MinHashEncoder, OneHotEncoder01, OrdinalEncoder, TableVectorizer, TargetEncoder, TextEncoder,
)
from rowtrail.features.scaling import MedianImputer, MostFrequentImputer, RobustScaler, SquashingScaler, StandardScaler
from rowtrail.functions.text import GRAM_FACTOR, MERSENNE, hash_factors
from rowtrail.operators import split
from rowtrail.plans.registry import query, rounded, shown
from rowtrail.plans.shop import CUSTOMERS_SQL, LINES_SQL, PRODUCTS_SQL

GAPS_SQL = f"""{PRODUCTS_SQL}, gaps AS (SELECT product_id, CASE WHEN product_id % 7 <> 0 THEN CAST(weight AS DOUBLE) END AS weight,
  CASE WHEN product_id % 9 <> 0 THEN category END AS category, brand FROM products)"""
ONE = "1::BIGINT AS prov_n"


def with_gaps(shop):
    """Products with missing weights and categories."""
    return shop.products().with_columns(
        {
            "weight": F.when(F.col("product_id") % 7 != 0, F.col("weight").cast("double")),
            "category": F.when(F.col("product_id") % 9 != 0, F.col("category")),
        }
    ).select("product_id", "weight", "category", "brand")


@query(
    "impute",
    f"""WITH {GAPS_SQL} SELECT product_id, coalesce(weight, (SELECT quantile_cont(weight, 0.5) FROM gaps)) AS weight,
    coalesce(category, (SELECT category FROM gaps WHERE category IS NOT NULL GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)) AS category,
    {ONE}, 'products:' || product_id AS prov FROM gaps""",
)
def impute(shop):
    t = with_gaps(shop).select("product_id", "weight", "category")
    steps = Branches([MedianImputer(["weight"]), MostFrequentImputer(["category"])], keep=("product_id",))
    return shown(steps.fit(t).transform(t))


def _numbers(shop):
    t = shop.lines().select("l_orderkey", "l_extendedprice", "l_quantity", "l_tax", "l_linenumber")
    return t.with_columns(
        {
            "fixed": F.lit(5.0),
            "rare": F.when(F.col("l_linenumber") == 1, F.lit(100.0)).otherwise(F.lit(0.0)),
            "endless": F.when(F.col("l_quantity") == 50, F.lit(float("inf")))
            .when(F.col("l_quantity") == 1, F.lit(float("-inf"))).otherwise(F.col("l_quantity")),
        }
    ).drop("l_linenumber")


NUMBERS_SQL = f"""{LINES_SQL}, numbers AS (SELECT l_orderkey, l_extendedprice, l_quantity, l_tax, 5.0::DOUBLE AS fixed,
  CASE WHEN l_linenumber = 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS rare,
  CASE WHEN l_quantity = 50 THEN 'inf'::DOUBLE WHEN l_quantity = 1 THEN '-inf'::DOUBLE ELSE l_quantity END AS endless, rid FROM lines)"""


@query(
    "scale_std",
    f"""WITH {NUMBERS_SQL}, s AS (SELECT avg(l_extendedprice) m1, stddev_pop(l_extendedprice) s1, avg(l_tax) m2, stddev_pop(l_tax) s2 FROM numbers)
    SELECT l_orderkey, round((l_extendedprice - m1) / s1, 6) AS l_extendedprice, round((l_tax - m2) / s2, 6) AS l_tax, 0.0::DOUBLE AS fixed,
    {ONE}, 'lineitem:' || rid AS prov FROM numbers, s""",
)
def scale_std(shop):
    t = _numbers(shop).select("l_orderkey", "l_extendedprice", "l_tax", "fixed")
    columns = ["l_extendedprice", "l_tax", "fixed"]
    return rounded(shown(StandardScaler(columns).fit(t).transform(t)), columns)


@query(
    "scale_robust",
    f"""WITH {NUMBERS_SQL}, s AS (SELECT quantile_cont(l_extendedprice, 0.25) a1, quantile_cont(l_extendedprice, 0.5) m1, quantile_cont(l_extendedprice, 0.75) b1,
      quantile_cont(l_tax, 0.25) a2, quantile_cont(l_tax, 0.5) m2, quantile_cont(l_tax, 0.75) b2 FROM numbers)
    SELECT l_orderkey, round((l_extendedprice - m1) / (b1 - a1), 6) AS l_extendedprice, round((l_tax - m2) / (b2 - a2), 6) AS l_tax, rare,
    {ONE}, 'lineitem:' || rid AS prov FROM numbers, s""",
)
def scale_robust(shop):
    t = _numbers(shop).select("l_orderkey", "l_extendedprice", "l_tax", "rare")
    columns = ["l_extendedprice", "l_tax", "rare"]
    return rounded(shown(RobustScaler(columns).fit(t).transform(t)), columns)


@query(
    "squash",
    f"""WITH {NUMBERS_SQL}, q AS (SELECT quantile_cont(l_extendedprice, 0.25) a1, quantile_cont(l_extendedprice, 0.5) m1, quantile_cont(l_extendedprice, 0.75) b1,
      quantile_cont(endless, 0.25) FILTER (isfinite(endless)) a2, quantile_cont(endless, 0.5) FILTER (isfinite(endless)) m2,
      quantile_cont(endless, 0.75) FILTER (isfinite(endless)) b2 FROM numbers),
    z AS (SELECT l_orderkey, rid, endless, (l_extendedprice - m1) / (b1 - a1) AS z1, rare * 2 / 100.0 AS z2,
      CASE WHEN isfinite(endless) THEN (endless - m2) / (b2 - a2) END AS z3 FROM numbers, q)
    SELECT l_orderkey, round(z1 / sqrt(1 + (z1 / 3) * (z1 / 3)), 6) AS l_extendedprice, 0.0::DOUBLE AS fixed,
      round(z2 / sqrt(1 + (z2 / 3) * (z2 / 3)), 6) AS rare,
      CASE WHEN endless = 'inf'::DOUBLE THEN 3.0::DOUBLE WHEN endless = '-inf'::DOUBLE THEN -3.0::DOUBLE
        ELSE round(z3 / sqrt(1 + (z3 / 3) * (z3 / 3)), 6) END AS endless, {ONE}, 'lineitem:' || rid AS prov FROM z""",
)
def squash(shop):
    columns = ["l_extendedprice", "fixed", "rare", "endless"]
    t = _numbers(shop).select("l_orderkey", *columns)
    return rounded(shown(SquashingScaler(columns).fit(t).transform(t)), columns)


@query(
    "onehot",
    f"""SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INT) AS "o_orderpriority_1_URGENT", CAST(o_orderpriority = '2-HIGH' AS INT) AS "o_orderpriority_2_HIGH",
    CAST(o_orderpriority = '3-MEDIUM' AS INT) AS "o_orderpriority_3_MEDIUM", CAST(o_orderpriority = '4-NOT SPECIFIED' AS INT) AS "o_orderpriority_4_NOT_SPECIFIED",
    {ONE}, 'orders:' || o_orderkey AS prov FROM orders""",
)
def onehot(shop):
    t = shop.tracked("orders", "o_orderkey").select("o_orderkey", "o_orderpriority")
    # '5-LOW' is unknown to the encoder
    return shown(OneHotEncoder01(["o_orderpriority"]).fit(t.filter("o_orderpriority <> '5-LOW'")).transform(t))


@query(
    "onehot_sparse",
    f"""WITH c AS (SELECT DISTINCT p_name FROM part WHERE p_size > 3), r AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS i FROM c)
    SELECT p_partkey, CAST(r.i AS BIGINT) AS hot, (SELECT count(*) FROM c) AS width, {ONE}, 'part:' || p_partkey AS prov
    FROM part LEFT JOIN r ON r.p_name = part.p_name""",
)
def onehot_sparse(shop):
    t = shop.tracked("part", "p_partkey").select("p_partkey", "p_name")
    encoder = OneHotEncoder01(["p_name"], form="vector").fit(shop.tracked("part", "p_partkey").filter("p_size > 3"))
    full = shown(encoder.transform(t))
    # a sparse vector is (type, size, indices, values): it is never unfolded to its full width
    parts = F.unwrap_udt("p_name_onehot")
    return full.withColumns({"hot": F.get(parts["indices"], F.lit(0)).cast("long"), "width": parts["size"].cast("long")}).drop("p_name_onehot")


@query(
    "ordinal",
    f"""WITH {CUSTOMERS_SQL}, r AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS i FROM (SELECT DISTINCT state FROM customers WHERE state <> 'MACHINERY'))
    SELECT customer_id, coalesce(i, -1) AS state, {ONE}, 'customers:' || customer_id AS prov FROM customers c LEFT JOIN r ON r.state = c.state""",
)
def ordinal(shop):
    t = shop.customers().select("customer_id", "state")
    return shown(OrdinalEncoder(["state"]).fit(t.filter("state <> 'MACHINERY'")).transform(t))


@query(
    "column_transform",
    f"""WITH {GAPS_SQL}, i AS (SELECT product_id, coalesce(weight, (SELECT quantile_cont(weight, 0.5) FROM gaps)) AS weight,
      coalesce(category, (SELECT category FROM gaps WHERE category IS NOT NULL GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)) AS c, brand FROM gaps)
    SELECT product_id, round((weight - avg(weight) OVER ()) / stddev_pop(weight) OVER (), 6) AS weight,
    CAST(c = 'ECONOMY' AS INT) AS "category_ECONOMY", CAST(c = 'LARGE' AS INT) AS "category_LARGE", CAST(c = 'MEDIUM' AS INT) AS "category_MEDIUM",
    CAST(c = 'PROMO' AS INT) AS "category_PROMO", CAST(c = 'SMALL' AS INT) AS "category_SMALL", CAST(c = 'STANDARD' AS INT) AS "category_STANDARD",
    brand, {ONE}, 'products:' || product_id AS prov FROM i""",
)
def column_transform(shop):
    t = with_gaps(shop)
    steps = Branches(
        [
            Chain([MedianImputer(["weight"]), StandardScaler(["weight"])]),
            Chain([MostFrequentImputer(["category"]), OneHotEncoder01(["category"])]),
        ],
        keep=("product_id",), remainder="passthrough",
    )
    return rounded(shown(steps.fit(t).transform(t)), ["weight"])


IN_TEST = "(('0x' || substr(md5('0:' || {key}), 1, 8))::BIGINT < 4294967296 * {share})"


@query(
    "target_encode",
    f"""WITH {PRODUCTS_SQL}, s AS (SELECT *, {IN_TEST.format(key='product_id', share=0.25)} AS test FROM products),
    r AS (SELECT category, avg(weight) AS m FROM s WHERE NOT test AND category <> 'PROMO' GROUP BY category),
    g AS (SELECT avg(weight) AS m FROM s WHERE NOT test AND category <> 'PROMO')
    SELECT product_id, s.category, round(coalesce(r.m, (SELECT m FROM g)), 6) AS category_mean, {ONE}, 'products:' || product_id AS prov
    FROM s LEFT JOIN r ON r.category = s.category WHERE test""",
)
def target_encode(shop):
    # the training rows know nothing of one category: its test rows get the overall training mean
    train, test = split.train_test_split(shop.products(), 0.25, key="product_id")
    encoder = TargetEncoder("category", "weight", "category_mean").fit(train.filter("category <> 'PROMO'"))
    return rounded(
        shown(encoder.transform(test).select("product_id", "category", "category_mean")), ["category_mean"]
    )


def min_hash_sql(column: str, table: str, key: str, n: int) -> str:
    """SELECT of ``key`` and n min-hash columns over the 2- to 4-grams of a text column."""
    factors = hash_factors(n)
    def gram(k: int) -> str:
        number = str(k)
        for i in range(k):
            number = f"({number} * {GRAM_FACTOR} + us[i + {i}]) % {MERSENNE}"
        return f"[{number} FOR i IN range(1, len(us) - {k} + 2)]"

    values = ", ".join(
        f"coalesce(list_min([(x * {a} + {b}) % {MERSENNE} FOR x IN xs]) / {float(MERSENNE)}, 0.0) AS {column}_{i}"
        for i, (a, b) in enumerate(hash_factors(n))
    )
    return f"""SELECT k AS {key}, {values} FROM (SELECT k, list_distinct({" || ".join(gram(k) for k in (2, 3, 4))}) AS xs
      FROM (SELECT {key} AS k, [unicode(substr({column}, i, 1))::BIGINT FOR i IN range(1, length({column}) + 1)] AS us FROM {table}))"""


@query(
    "minhash_enc",
    f"""SELECT m.*, {ONE}, 'part:' || p_partkey AS prov FROM ({min_hash_sql('p_name', 'part', 'p_partkey', 30)}) m""",
)
def minhash_enc(shop):
    t = shop.tracked("part", "p_partkey").select("p_partkey", "p_name")
    return shown(MinHashEncoder(["p_name"], 30).fit(t).transform(t))


@query(
    "minhash_documents",
    f"""SELECT m.*, {ONE}, 'documents:' || doc_id AS prov FROM ({min_hash_sql('text', 'documents', 'doc_id', 30)}) m""",
)
def minhash_documents(shop):
    t = shop.documents().select("doc_id", "text")
    return shown(MinHashEncoder(["text"], 30).fit(t).transform(t))


def gap_weighed(shop):
    """Products with the activations of their names, those weighed and added up, and the number of grams; and the activations' names."""
    n = F.char_length("product_name")
    grams = reduce(lambda x, y: x + y, [F.greatest(n - k, F.lit(0)) for k in (1, 2, 3)])
    t = shop.products().select("product_id", "product_name").with_columns({"grams": grams})
    encoder = GapEncoder(["product_name"], 30).fit(t)
    below = encoder.models["product_name"].below.tolist()
    parts = [F.col(c) * F.lit(b) for c, b in zip(encoder.outputs(), below)]
    return encoder.transform(t).with_columns({"weighed": reduce(lambda x, y: x + y, parts)}), encoder.outputs()


def grams_sql(column: str) -> str:
    return " + ".join(f"greatest(length({column}) - {n}, 0)" for n in (1, 2, 3))


@query("gap_enc", f"SELECT p_partkey AS product_id, true AS weights_ok, {ONE}, 'products:' || p_partkey AS prov FROM part")
def gap_enc(shop):
    """Activations are not negative; weighed, they add up to the number of grams and what the prior adds."""
    t, outputs = gap_weighed(shop)
    ok = (F.array_min(F.array(*outputs)) >= 0) & (F.abs(F.col("weighed") - F.col("grams") - 3) < 1e-5)
    return shown(t.with_columns({"weights_ok": ok}).select("product_id", "weights_ok"))


@query(
    "gap_totals",
    f"SELECT p_partkey AS product_id, CAST({grams_sql('p_name')} + 3 AS DOUBLE) AS weighed, {ONE}, 'products:' || p_partkey AS prov FROM part",
)
def gap_totals(shop):
    """What the activations add up to: the number of grams of each name, and a tenth per component from the prior."""
    return rounded(shown(gap_weighed(shop)[0].select("product_id", "weighed")), ["weighed"], 4)


@query("text_enc", f"SELECT doc_id, true AS variances_fall, {ONE}, 'documents:' || doc_id AS prov FROM documents")
def text_enc(shop):
    """The components' variances over the training rows fall from first to last."""
    t = shop.documents().select("doc_id", "text")
    encoder = TextEncoder(["text"], 30).fit(t)
    t = encoder.transform(t).stored("components")
    spreads = list(t.df.agg(*[F.var_pop(c) for c in encoder.outputs()]).first())
    fall = all(a >= b * (1 - 1e-6) for a, b in zip(spreads, spreads[1:])) and spreads[0] > 0
    return shown(t.with_columns({"variances_fall": F.lit(fall)}).select("doc_id", "variances_fall"))


@query(
    "vectorize",
    f"""SELECT p_partkey, p_size, p_retailprice, {", ".join(f"CAST(p_type = '{k}' AS INT) AS p_type_{k}" for k in ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'))},
    m.* EXCLUDE (k), {ONE}, 'part:' || p_partkey AS prov FROM part JOIN
    ({min_hash_sql('p_name', 'part', 'p_partkey', 4).replace('SELECT k AS p_partkey', 'SELECT k')}) m ON m.k = p_partkey""",
)
def vectorize(shop):
    t = shop.tracked("part", "p_partkey").drop("p_brand")
    vectorizer = TableVectorizer(lambda columns: MinHashEncoder(columns, 4), exclude=("p_partkey",))
    return shown(vectorizer.fit(t).transform(t))


@query(
    "split",
    f"""SELECT o_orderkey, CAST({IN_TEST.format(key='o_orderkey', share=0.25)} AS INT) AS in_test, {ONE}, 'orders:' || o_orderkey AS prov FROM orders""",
)
def split_query(shop):
    train, test = split.train_test_split(shop.tracked("orders", "o_orderkey").select("o_orderkey"), key="o_orderkey")
    both = [shown(part.with_columns({"in_test": F.lit(i)})) for i, part in enumerate((train, test))]
    return both[0].unionByName(both[1])


RANKED = """ranked AS (SELECT {columns}, row_number() OVER (PARTITION BY {label} ORDER BY ('0x' || substr(md5('0:' || {key}), 1, 8))::BIGINT,
  CAST({key} AS VARCHAR)) AS r, count(*) OVER (PARTITION BY {label}) AS n FROM {table})"""


@query(
    "split_stratified",
    f"""WITH {RANKED.format(columns='o_orderkey, o_orderstatus', label='o_orderstatus', key='o_orderkey', table='orders')}
    SELECT o_orderkey, o_orderstatus, CAST(r <= floor(n * 0.2 + 0.5) AS INT) AS in_test, {ONE}, 'orders:' || o_orderkey AS prov FROM ranked""",
)
def split_stratified(shop):
    t = shop.tracked("orders", "o_orderkey").select("o_orderkey", "o_orderstatus")
    train, test = split.stratified_split(t, "o_orderstatus", 0.2, key="o_orderkey")
    both = [shown(part.with_columns({"in_test": F.lit(i)})) for i, part in enumerate((train, test))]
    return both[0].unionByName(both[1])


@query(
    "under_sample",
    f"""WITH {RANKED.format(columns='event_id, event_type', label='event_type', key='event_id', table='events')}
    SELECT event_id, event_type, {ONE}, 'events:' || event_id AS prov FROM ranked WHERE r <= (SELECT min(n) FROM ranked)""",
)
def under_sample(shop):
    t = shop.tracked("events", "event_id").select("event_id", "event_type")
    return shown(split.under_sample(t, "event_type", key="event_id"))


@query(
    "folds",
    f"""SELECT event_id, CAST(('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT % 5 AS INT) AS fold, {ONE}, 'events:' || event_id AS prov FROM events""",
)
def folds(shop):
    return shown(split.with_folds(shop.tracked("events", "event_id").select("event_id"), 5, key="event_id"))
