"""Hot groups, edge cases and plans: what must hold whatever the data."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtrail import Trail, aggregate, join, register_operator
from rowtrail.features.encoding import (
    GapEncoder, MinHashEncoder, OneHotEncoder01, OrdinalEncoder, TableVectorizer, TargetEncoder, TextEncoder, embed_with_model,
)
from rowtrail.features.scaling import RobustScaler, SquashingScaler, StandardScaler
from rowtrail.functions import text, time
from rowtrail.functions.text import min_hashes, trigram_set
from rowtrail.operators import fuzzy, lineage, split
from rowtrail.operators.fuzzy import best_matches, fuzzy_join
from rowtrail.operators.text_join import aggregate_python, join_text, join_whole_text, text_parts
from rowtrail.sources.readers import read_csv, write_csv, write_parquet


@pytest.fixture
def hot(source):
    """One key holds most rows; row ids are positions."""

    def make(trail):
        rows = [("hot", i) for i in range(40)] + [("cold", i) for i in range(3)]
        return source(trail, "t", "k string, v bigint", *rows)

    return make


def test_hot_groups_come_in_parts_and_stay_whole(hot):
    t = aggregate(hot(Trail()), "k", n=("v", "count"))
    rows = lineage.set_parts(t, ["k"], part_ids=8).collect()
    hot_parts = sorted((r["_part"], r["_prov"]) for r in rows if r["k"] == "hot")
    assert hot_parts == [(i, list(range(8 * i, 8 * i + 8))) for i in range(5)]
    assert [(r["_part"], r["_prov"]) for r in rows if r["k"] == "cold"] == [(0, [40, 41, 42])]
    with pytest.raises(ValueError, match="set_parts"):
        lineage.consolidate(t, part_ids=8)
    assert {r["k"]: r["_prov"] for r in lineage.consolidate(t).collect()} == {"hot": list(range(40)), "cold": [40, 41, 42]}


def test_text_of_hot_groups(hot):
    t = hot(Trail()).with_columns({"v": F.when(F.col("v") != 1, F.col("v").cast("string"))})
    rows = text_parts(t, ["k"], {"text": "v"}, part_rows=8).collect()
    parts = sorted((r["_part"], r["text"]) for r in rows if r["k"] == "hot")
    whole = " ".join(str(i) for i in range(40) if i != 1)
    assert [p for p, _ in parts] == [0, 1, 2, 3, 4] and " ".join(x for _, x in parts) == whole
    assert [r["text"] for r in rows if r["k"] == "cold"] == ["0 2"]
    with pytest.raises(ValueError, match="text_parts"):
        join_text(t, ["k"], {"text": "v"}, part_rows=8)
    assert {r["k"]: r["text"] for r in join_text(t, ["k"], {"text": "v"}).df.collect()} == {"hot": whole, "cold": "0 2"}
    empty = join_text(t.filter("v is null"), ["k"], {"text": "v"})
    assert {r["text"] for r in empty.df.collect()} == {""}


def test_whole_text_of_hot_groups(hot):
    t = hot(Trail()).with_columns({"v": F.when((F.col("v") < 8) | (F.col("v") > 17), F.col("v").cast("string")), "n": F.col("v")})
    whole = " ".join(str(i) for i in range(40) if not 8 <= i <= 17)
    joined = join_whole_text(t, ["k"], {"text": "v", "again": "v"}, part_rows=4, most=F.max("n"))
    assert {tuple(r) for r in joined.df.select("k", "text", "again", "most").collect()} == {
        ("hot", whole, whole, 39), ("cold", "0 1 2", "0 1 2", 2),
    }
    assert {r["k"]: r["_prov"] for r in lineage.consolidate(joined).collect()} == {"hot": list(range(40)), "cold": [40, 41, 42]}
    empty = join_whole_text(t.with_columns({"v": F.lit(None).cast("string")}), ["k"], {"text": "v"}, part_rows=4)
    assert [r["text"] for r in empty.df.collect()] == ["", ""]


def test_long_texts_are_encoded_in_pieces(spark, source, monkeypatch):
    """The same numbers whatever the length of the pieces."""
    texts = ["", "a", None, "  two  Words ", "abcdefgh" * 3, " ".join(f"w{i % 7}" for i in range(60)), " " * 30 + "x" + " " * 30, "\u00e9\u4e2d " * 11]
    t = source(Trail(), "t", "i bigint, s string", *[(i, s) for i, s in enumerate(texts * 2)])

    def encoded():
        counts = GapEncoder(["s"], 3)._counted(t.df, "s").select("i", "_counts").collect()
        words = TextEncoder(["s"], 3)._counted(t.df, "s").select("i", "_tf").collect()
        hashes = t.df.select("i", min_hashes(F.coalesce("s", F.lit("")), 5)).collect()
        topics = GapEncoder(["s"], 3).fit(t).transform(t).df
        assert topics.count() == len(texts) * 2 and set(topics.columns) == {*t.df.columns, "s_0", "s_1", "s_2"} - {"s"}
        return [{r[0]: list(r[1].toArray() if hasattr(r[1], "toArray") else r[1]) for r in rows} for rows in (counts, words, hashes)]

    whole = encoded()
    monkeypatch.setattr(text, "PIECE_CHARS", 7)
    assert encoded() == whole


def test_parts_of_a_fan_out(source):
    """One left row meets many right rows, some rows meet none: parts stay bounded and whole."""
    trail = Trail()
    left = source(trail, "l", "k bigint, g string", (1, "a"), (2, "a"), (3, "b"))
    right = source(trail, "r", "k bigint, v string", *[(1, str(i)) for i in range(40)])
    t = join(left, right, on="k", how="left")
    rows = text_parts(t, ["g"], {"v": "v", "g2": "g"}, part_rows=8).collect()
    parts = sorted((r["_part"], r["v"], r["g2"]) for r in rows if r["g"] == "a")
    assert [p for p, _, _ in parts] == list(range(6)) and max(len(x.split()) for _, x, _ in parts) <= 8
    assert " ".join(x for _, x, _ in parts).split() == [str(i) for i in range(40)]
    assert sum(len(x.split()) for _, _, x in parts) == 41
    assert [(r["_part"], r["v"]) for r in rows if r["g"] == "b"] == [(0, "")]


def test_two_trails_never_meet(source):
    a = source(Trail(), "a", "k bigint", (1,))
    b = source(Trail(), "b", "k bigint, v string", (1, "x"))
    with pytest.raises(ValueError, match="trail"):
        join(a, b, on="k")
    with pytest.raises(ValueError, match="trail"):
        fuzzy_join(a.rename({"k": "l"}), b, "l", "k")


@pytest.mark.parametrize("bad", [1 << 48, -1, None])
def test_row_numbers_out_of_range(spark, bad):
    t = Trail().source(spark.createDataFrame([(bad, 1)], "k bigint, v int"), "t", row_key="k")
    assert t.untracked().select("v").count() == 1
    with pytest.raises(Exception, match="row number"):
        t.df.collect()


def test_repeated_row_keys_count_once(spark):
    t = Trail().source(spark.createDataFrame([(3, "a"), (3, "a")], "k bigint, g string"), "t", row_key="k")
    t = aggregate(t, "g", n=("k", "count"))
    assert [tuple(r) for r in lineage.edges(t, ["g"]).collect()] == [("a", 0, 3)]
    assert lineage.summary(t, ["g"]).first()["prov_n"] == 1


def test_whole_frame_aggregates_answer_after_filters(source):
    trail = Trail()
    t = aggregate(source(trail, "a", "v bigint", (1,), (2,)), total=("v", "sum"))
    kept = t.with_columns({"twice": F.col("total") * 2}).filter("twice > 1")
    assert sorted(tuple(r) for r in lineage.edges(kept, ["total"]).collect()) == [(3, 0, 0), (3, 0, 1)]
    assert lineage.edges(t.filter("total > 5"), ["total"]).count() == 0
    b = source(trail, "b", "total bigint, x bigint", (3, 1), (3, 2))
    both = join(b, t, on="total")
    with pytest.raises(ValueError, match="factored"):
        lineage.edges(both, ["x"])
    rows, members = lineage.factored(both, ["x"])
    assert rows.count() == 4 and members.count() == 2
    joined = rows.filter("group is not null").drop("table_id", "row_id").join(members, "group")
    assert sorted((r["x"], r["row_id"]) for r in joined.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_one_hot_names_never_meet(source):
    t = source(Trail(), "a", "x string, x_y string, `x_y_z` int", ("y_z", "z", 7))
    encoder = OneHotEncoder01(["x", "x_y"]).fit(t)
    out = encoder.transform(t)
    assert len(set(encoder.outputs())) == 2 and out.df.first()["x_y_z"] == 7
    assert all(out.df.first()[c] == 1 for c in encoder.outputs())


def test_table_vectorizer_counts_exactly(source):
    t = source(Trail(), "a", "lo string, hi string", *[(f"v{i % 40}", f"v{i % 41}") for i in range(41)])
    fitted = TableVectorizer(lambda c: MinHashEncoder(c, 2)).fit(t)
    assert [s.columns for s in fitted.steps] == [["lo"], ["hi"]]


def test_small_test_fractions_are_not_rounded_away(source):
    t = source(Trail(), "a", "i bigint", *[(i,) for i in range(20000)])
    _, test = split.train_test_split(t, 0.0004)
    assert 0 < test.df.count() < 30


def test_python_aggregate_in_blocks(hot):
    t = aggregate_python(
        hot(Trail()), ["k"], "v", "total", lambda s: [float(s.sum())], lambda s: float(sum(x[0] for x in s)), part_rows=8
    )
    assert {r["k"]: r["total"] for r in t.untracked().collect()} == {"hot": 780.0, "cold": 3.0}
    assert lineage.edges(t, ["k"]).count() == 43


def test_python_aggregate_keeps_keys_and_values_and_shuffles_states_only(spark):
    def partial(values):
        assert len(values) <= 4
        return [float(len(values)), float(values.sum())]

    rows = [(i, [i % 2, None], (i % 3,), None if i % 5 == 0 else i) for i in range(60)]
    t = Trail().source(spark.createDataFrame(rows, "n bigint, a array<int>, s struct<x: int>, v bigint").repartition(3), "t", row_key="n")
    merge = lambda states: sum(s[0] for s in states) * 1e6 + sum(s[1] for s in states)
    found = aggregate_python(t, ["a", "s"], "v", "total", partial, merge, part_rows=4).untracked()
    wanted = {}
    for _, a, s, v in rows:
        n, total = wanted.get((tuple(a), s), (0, 0))
        wanted[tuple(a), s] = (n + (v is not None), total + (v or 0))
    assert {(tuple(r["a"]), tuple(r["s"])): r["total"] for r in found.collect()} == {k: n * 1e6 + x for k, (n, x) in wanted.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    one = aggregate_python(t, [], "v", "total", partial, merge, part_rows=4).untracked().collect()
    assert [r["total"] for r in one] == [48 * 1e6 + sum(i for i in range(60) if i % 5)]


def test_bag_counts_every_path(source):
    trail = Trail()
    left = source(trail, "l", "k bigint", (1,), (1,), (2,))
    right = source(trail, "r", "k bigint, g string", (1, "a"), (2, "a"))
    t = aggregate(join(left, right, on="k"), "g", n=("k", "count"))
    bag = {(r["table_id"], r["row_id"]): r["times"] for r in lineage.edges(t, ["g"], bag=True).collect()}
    assert bag == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (1, 0): 2, (1, 1): 1}
    row = lineage.consolidate(t, reducer="bag").first()
    assert dict(zip(row["_prov"], row["_times"])) == {0: 1, 1: 1, 2: 1, 1 << 48: 2, (1 << 48) + 1: 1}


def test_aggregate_of_aggregate_with_unmatched_row(source, tokens):
    trail = Trail()
    a = source(trail, "a", "id bigint, g string", (0, "x"), (1, "x"), (2, "y"))
    b = source(trail, "b", "id bigint, v bigint", (0, 5), (0, 6), (9, 7))
    t = join(a, aggregate(b, "id", v=("v", "sum")), on="id", how="left")
    assert tokens(aggregate(t, "g", v=("v", "sum")), "g") == {"x": {"a:0", "a:1", "b:0", "b:1"}, "y": {"a:2"}}


def test_filter_after_aggregate_traces_only_what_is_left(source, tokens):
    t = aggregate(source(Trail(), "a", "g string, v bigint", ("x", 1), ("y", 2), ("x", 3)), "g", v=("v", "sum"))
    assert tokens(t.filter("v > 2"), "g") == {"x": {"a:0", "a:2"}}
    assert tokens(t.rename({"g": "h"}), "h") == {"x": {"a:0", "a:2"}, "y": {"a:1"}}


def test_null_keys(source, tokens):
    trail = Trail()
    t = source(trail, "a", "g string, v bigint", (None, 1), ("y", 2), (None, 3))
    assert tokens(aggregate(t, "g", v=("v", "sum")), "g") == {"y": {"a:1"}}
    kept = aggregate(t, "g", dropna=False, v=("v", "sum"))
    assert tokens(kept, "g") == {None: {"a:0", "a:2"}, "y": {"a:1"}}
    assert tokens(kept.filter("v > 2"), "g") == {None: {"a:0", "a:2"}}
    other = source(trail, "b", "g string, w bigint", (None, 1), ("z", 2))
    assert join(t, other, on="g").df.count() == 0
    assert tokens(join(t, other, on="g", null_keys="match"), "v") == {1: {"a:0", "b:0"}, 3: {"a:2", "b:0"}}


def test_same_source_twice(source, tokens):
    trail = Trail()
    t = source(trail, "a", "id bigint, up bigint", (0, 1), (1, 0), (2, 2))
    twice = join(t, t, left_on="up", right_on="id", suffixes=("", "_b"))
    assert tokens(twice, "id") == {0: {"a:0", "a:1"}, 1: {"a:0", "a:1"}, 2: {"a:2"}}
    thrice = join(twice, t, left_on="up_b", right_on="id", suffixes=("", "_c"))
    assert len(thrice.hidden) == 3 and tokens(thrice, "id")[2] == {"a:2"}


def test_names_and_misuse(source):
    trail = Trail()
    a = source(trail, "a", "id bigint, v string", (0, "p"))
    with pytest.raises(ValueError):
        join(a, a, on="id")
    with pytest.raises(TypeError):
        aggregate(a, "id", "sum")
    with pytest.raises(ValueError):
        a.with_columns({"_prov7": F.lit(1)})
    register_operator("loses", lambda t: t.df)
    with pytest.raises(TypeError):
        a.apply("loses")


def test_sufficiency_on_random_tables(spark):
    """An output row computed from nothing but its lineage rows is the same row."""
    rng = np.random.default_rng(3)
    facts = [(i, int(rng.integers(0, 6)), int(rng.integers(0, 100))) for i in range(80)]
    dims = [(i, i % 4, f"g{i % 3}") for i in range(6)]
    f = spark.createDataFrame(facts, "n bigint, k bigint, v bigint")
    d = spark.createDataFrame(dims, "n bigint, k bigint, g string")

    def run(facts_df, dims_df):
        trail = Trail()
        t = join(trail.source(facts_df, "f", row_key="n").drop("n"), trail.source(dims_df, "d", row_key="n").drop("n"), on="k")
        return aggregate(t.filter("v > 20"), "g", total=("v", "sum"), top=("v", "max"))

    whole = run(f, d)
    edges = lineage.edges(whole, ["g"]).collect()
    for row in whole.untracked().collect():
        mine = {(e["table_id"], e["row_id"]) for e in edges if e["g"] == row["g"]}
        again = run(
            f.filter(F.col("n").isin([r for t, r in mine if t == 0])), d.filter(F.col("n").isin([r for t, r in mine if t == 1]))
        )
        assert row in again.untracked().collect()


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    trail = Trail()
    orders = trail.source(spark.read.parquet(f"{sf}/orders.parquet"), "orders", row_key="o_orderkey")
    customer = trail.source(spark.read.parquet(f"{sf}/customer.parquet"), "customer", row_key="c_custkey")
    t = join(orders.filter("o_orderstatus = 'F'"), customer, left_on="o_custkey", right_on="c_custkey")
    t = aggregate(t, "c_mktsegment", n=("o_orderkey", "count"))
    for df in (t.untracked(), lineage.edges(t, ["c_mktsegment"]), lineage.with_summary(t, ["c_mktsegment"])):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text
        assert "EqualTo(o_orderstatus,F)" in text
    # data alone: no id is computed, and only the needed columns are read
    text = plan(t.untracked())
    assert "_prov" not in text and "o_totalprice" not in text


def test_fuzzy_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["red ring", "blue bolt", "hot gear", "small gizmo", "old widget", "green nut"]

    def noise(w):
        i = int(rng.integers(0, len(w)))
        return w[:i] + "xyz"[int(rng.integers(0, 3))] + w[i + int(rng.integers(0, 2)) :]

    left = sorted({noise(words[i % 6]) for i in range(60)} | {"a", "Red Ring", "qqqq"})
    right = sorted({noise(words[i % 6]) for i in range(60)} | {"red ring", "b"})

    def grams(s):
        p = "  " + s.lower() + "  "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    def brute(limit):
        out = {}
        for a in left:
            pairs = [(1 - len(grams(a) & grams(b)) / len(grams(a) | grams(b)), a.lower() != b.lower(), b) for b in right]
            d, _, b = min(pairs)
            if d <= limit:
                out[a] = (b, round(d, 9))
        return out

    ldf, rdf = (spark.createDataFrame([(x,) for x in side], "k0 string") for side in (left, right))
    for limit in (None, 0.9, 0.5):
        for small in (10**9, 0):
            got = best_matches(ldf, rdf, 1, limit, small_meetings=small).collect()
            assert {r["l0"]: (r["r0"], round(r["distance"], 9)) for r in got} == brute(1.0 if limit is None else limit), (limit, small)


def test_numbers_meet_on_several_grams_together(spark):
    left = [f"x{i}" for i in range(10000, 30000, 67)] + ["12", "7", "no number", "1234 and a long text about the number 1234 which has many grams"]
    right = [str(i) for i in range(10000, 30000, 3)] + ["x9", "a long text about the number 1234 which has many grams, 99"]
    ldf, rdf = (spark.createDataFrame([(x,) for x in side], "k0 string") for side in (left, right))

    def found(small):
        return {(r["l0"], r["r0"], round(r["distance"], 9)) for r in best_matches(ldf, rdf, 1, 0.5, small_meetings=small).collect()}

    assert found(0) == found(10**9)
    keys = [df.withColumn(f"{side}id", F.xxhash64("k0")) for df, side in ((ldf, "l"), (rdf, "r"))]
    sets = fuzzy._rare_first(*[fuzzy._grams(df, ["k0"], side) for df, side in zip(keys, "lr")])
    met = []
    for together in (1, 3):
        sides = [fuzzy._with_spare(df, side, 0.5).withColumn("own", F.least("own", F.lit(together))) for df, side in zip(sets, "lr")]
        levels = [{r["own"] for r in df.select("own").distinct().collect()} for df in sides]
        met.append(fuzzy._signature_meetings(*fuzzy._signatures(*sides, *levels), 1)[0])
    assert met[1] * 5 < met[0], met


def test_short_texts(spark):
    df = spark.createDataFrame([("",), ("a",), ("ab",)], "s string")
    rows = df.select(trigram_set(F.col("s")).alias("g"), min_hashes(F.col("s"), 3).alias("h")).collect()
    assert [len(r["g"]) for r in rows] == [1, 3, 4]
    assert rows[0]["h"] == [0.0, 0.0, 0.0] and all(0 < x < 1 for x in rows[2]["h"])


def test_days_round_down(spark):
    df = spark.sql("select timestamp_ntz'2020-01-02 00:00:00' a, timestamp_ntz'2020-01-02 01:00:00' b")
    row = df.select(time.whole_days(F.col("a"), F.col("b")), time.whole_days(F.col("b"), F.col("a"))).first()
    assert tuple(row) == (-1, 0)


def test_scalers_on_degenerate_columns(source):
    inf = float("inf")
    values = [(1.0, 5.0, 0.0), (2.0, 5.0, 0.0), (3.0, 5.0, 0.0), (4.0, 5.0, 0.0), (inf, 5.0, 10.0), (-inf, 5.0, 0.0), (None, None, None)]
    t = source(Trail(), "a", "x double, c double, z double", *values)
    out = SquashingScaler(["x", "c", "z"]).fit(t).transform(t).df.orderBy("_prov0").collect()
    assert (out[4]["x"], out[5]["x"], out[6]["x"]) == (3.0, -3.0, None)
    assert {r["c"] for r in out} == {0.0, None} and out[4]["z"] == pytest.approx(2 / np.sqrt(1 + 4 / 9))
    out = RobustScaler(["c"]).fit(t).transform(t).df.collect()
    assert {r["c"] for r in out} == {0.0, None}
    out = StandardScaler(["c"]).fit(t).transform(t).df.collect()
    assert {r["c"] for r in out} == {0.0, None}


def test_unseen_categories(source):
    trail = Trail()
    train = source(trail, "a", "c string, y int", ("a", 1), ("b", 0), (None, 1))
    test = source(trail, "b", "c string, y int", ("a", 0), ("z", 0), (None, 0))
    ordinal = OrdinalEncoder(["c"]).fit(train).transform(test)
    assert [r["c"] for r in ordinal.df.orderBy(*ordinal.hidden).collect()] == [0, -1, -1]
    hot = OneHotEncoder01(["c"]).fit(train).transform(test)
    assert [(r["c_a"], r["c_b"]) for r in hot.df.orderBy(*hot.hidden).collect()] == [(1, 0), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        OrdinalEncoder(["_prov0"])


def test_target_means_come_from_train_only(source):
    trail = Trail()
    train = source(trail, "train", "c string, late int", ("A", 1), ("A", 0), ("B", 0), ("B", 0))
    test = source(trail, "test", "c string", ("A",), ("B",), ("C",))
    out = TargetEncoder("c", "late", "rate").fit(train).transform(test)
    assert [r["rate"] for r in out.df.orderBy("c").collect()] == [0.5, 0.0, 0.25]
    assert out.scalars == test.scalars


def test_splits_are_exact_and_disjoint(source):
    t = source(Trail(), "a", "c string, i bigint", *[("x" if i % 3 else "y", i) for i in range(100)])
    train, test = split.stratified_split(t, "c", 0.2)
    assert {r["c"]: r["count"] for r in test.df.groupBy("c").count().collect()} == {"x": 13, "y": 7}
    assert train.df.count() + test.df.count() == 100 and train.df.select("i").intersect(test.df.select("i")).count() == 0
    assert {r["count"] for r in split.under_sample(t, "c").df.groupBy("c").count().collect()} == {34}


def test_own_embedding_model_and_register(source, spark):
    trail = Trail()
    t = source(trail, "a", "s string", ("ab",), ("abc",))
    out = embed_with_model(t, "s", "v", lambda: lambda texts: [[len(x), 1] for x in texts])
    assert [(r["s"], r["v"]) for r in out.df.orderBy("s").collect()] == [("ab", [2.0, 1.0]), ("abc", [3.0, 1.0])]
    assert out.hidden == t.hidden
    assert [tuple(r) for r in trail.as_table(spark).collect()] == [(0, "a")]


def test_files_round_trip(source, spark, tmp_path):
    t = source(Trail(), "a", "x bigint, s string", (1, "p"), (2, None))
    write_csv(t.untracked(), str(tmp_path / "csv"))
    write_parquet(lineage.edges(t, ["x"]), str(tmp_path / "edges"))
    back = read_csv(spark, str(tmp_path / "csv"), "x bigint, s string")
    assert lineage.differences(back, t.untracked()).count() == 0
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 2
