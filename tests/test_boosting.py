"""Boosted trees beside a plain Python booster: the same scores whichever way the trees grow."""

import heapq
import math
import random
import threading

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rowtrail import Trail
from rowtrail.features import boosting
from rowtrail.features.boosting import Settings, Shape, Training, best_split, boost, test_scores as scores_of
from rowtrail.features.learn import Learner, baseline, cross_validate, cross_validate_all, score, verdicts

WAYS = {"one_task": {}, "jobs": {"one_task_bytes": 0}, "two_stages": {"one_task_bytes": 0, "direct_bytes": 0}}


def brute(rows, y, s: Settings):
    """Raw scores of all rows; ``rows`` are lists of numbers and None."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    mean = sum(y) / len(y)
    raw = [math.log(mean / (1 - mean)) if s.kind == "classifier" else mean] * len(y)
    values = [sorted({r[f] for r in rows if r[f] is not None}) for f in range(len(rows[0]))]

    def split(ids, g, h):
        gt, ht = sum(g[i] for i in ids), sum(h[i] for i in ids)
        best = (1e-10, None)
        for f, vs in enumerate(values):
            lost = [i for i in ids if rows[i][f] is None]
            for v in vs:
                for side in (0, 1) if lost else (0,):
                    left = [i for i in ids if rows[i][f] is not None and rows[i][f] <= v] + (lost if side else [])
                    n, m = len(left), len(ids) - len(left)
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if min(n, m) < s.least_rows or min(hl, ht - hl) < s.least_hessian:
                        continue
                    gain = gl * gl / hl + (gt - gl) ** 2 / (ht - hl) - gt * gt / ht
                    if gain > best[0] + 1e-9:
                        best = (gain, set(left))
        return best

    for _ in range(s.iterations):
        g = [sigmoid(r) - t if s.kind == "classifier" else r - t for r, t in zip(raw, y)]
        h = [sigmoid(r) * (1 - sigmoid(r)) if s.kind == "classifier" else 1.0 for r in raw]
        leaves, heap = [], []

        def offer(ids, depth):
            gain, left = split(ids, g, h) if depth < s.depth else (0, None)
            if left is None:
                leaves.append(ids)
            else:
                heapq.heappush(heap, (-gain, len(heap) + len(leaves) * 1000, depth, ids, left))

        offer(list(range(len(y))), 0)
        while heap and len(leaves) + len(heap) < s.leaves:
            _, _, depth, ids, left = heapq.heappop(heap)
            offer([i for i in ids if i in left], depth + 1)
            offer([i for i in ids if i not in left], depth + 1)
        for ids in leaves + [x[3] for x in heap]:
            add = -s.rate * sum(g[i] for i in ids) / sum(h[i] for i in ids)
            for i in ids:
                raw[i] += add
    return raw


def numbers(n=260, seed=1):
    rng = random.Random(seed)
    rows = [[rng.randrange(12), None if rng.random() < 0.2 else round(rng.gauss(0, 1), 2), rng.choice([None, 1.5, 2.5])] for _ in range(n)]
    y = [2.0 * r[0] + (5 if r[1] is None else 3 * r[1]) + (4 if r[2] is None else 0) + rng.gauss(0, 1) for r in rows]
    return rows, y


def framed(spark, rows, y, **more):
    out = [(i, *[None if v is None else float(v) for v in r], float(t), *[m[i] for m in more.values()]) for i, (r, t) in enumerate(zip(rows, y))]
    return spark.createDataFrame(out, "i long, a double, b double, c double, y double" + "".join(f", {k} boolean" for k in more)).repartition(3, "i")


def raw_of(df, booster):
    return [r["raw"] for r in df.withColumn("raw", booster.column(df)).orderBy("i").collect()]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("kind,leaves", [("regressor", 31), ("classifier", 5)])
def test_same_scores_as_plain_python(spark, way, kind, leaves):
    rows, y = numbers()
    if kind == "classifier":
        y = [float(t > sorted(y)[len(y) // 3]) for t in y]
    s = Settings(kind, iterations=12, depth=3, leaves=leaves, least_rows=8, early_stopping=False)
    df = framed(spark, rows, y)
    [booster], blocks = boost([Training(df, ["a", "b", "c"], "y")], s, **WAYS[way])
    assert len(booster.trees) == 12 and max((t.left >= 0).sum() + 1 for t in booster.trees) <= leaves
    assert np.allclose(raw_of(df, booster), brute(rows, y, s), atol=1e-9)
    assert scores_of(blocks).count() == 0


@pytest.mark.parametrize("way", WAYS)
def test_models_grow_beside_each_other(spark, way):
    """Two models with features of their own, one of them with test rows, NULL labels and a vector."""
    rows, y = numbers()
    test = [i % 4 == 0 for i in range(len(y))]
    df = framed(spark, rows, y, t=test)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v", handleInvalid="keep").transform(df)
    vectors = vectors.withColumn("y", F.when(F.col("i") % 10 != 3, F.col("y")))
    s = Settings("regressor", iterations=5, depth=3, least_rows=8, early_stopping=False)
    (one, two), blocks = boost([Training(df, ["a"], "y"), Training(vectors, ["v"], "y", "t")], s, **WAYS[way])
    assert np.allclose(raw_of(df, one), brute([r[:1] for r in rows], y, s), atol=1e-9)
    kept = [i for i in range(len(y)) if not test[i] and i % 10 != 3]
    want = brute([rows[i] for i in kept], [y[i] for i in kept], s)
    got = raw_of(vectors, two)
    assert np.allclose([got[i] for i in kept], want, atol=1e-9)
    tested = sorted((r["model"], r["y"], r["raw"]) for r in scores_of(blocks).collect())
    assert np.allclose(tested, sorted((1, y[i], got[i]) for i in range(len(y)) if test[i] and i % 10 != 3))


def test_early_stopping(spark):
    rng = random.Random(3)
    rows, y = numbers(600)
    noise = [float(rng.random() < 0.5) for _ in y]
    df = framed(spark, rows, noise)
    s = Settings("classifier", least_rows=5, early_stopping=True, patience=3)
    found = [boost([Training(df, ["a", "b", "c"], "y")], s, **WAYS[w])[0][0] for w in WAYS]
    assert 3 <= len(found[0].trees) < 100 and len({len(b.trees) for b in found}) == 1
    assert np.allclose(raw_of(df, found[0]), raw_of(df, found[2]), atol=1e-9)
    plain = boost([Training(df, ["a", "b", "c"], "y")], Settings("classifier", least_rows=5))[0][0]
    assert len(plain.trees) == 100  # few rows: all rounds


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 0.0)], "i long, a double, y double")
    for training in (Training(df, ["a"], "y"), Training(df.limit(0), ["a"], "y"), Training(df, [], "y"), Training(df.withColumn("a", F.lit(float("nan"))), ["a"], "y")):
        for way in WAYS.values():
            [booster], _ = boost([training], Settings(iterations=2), **way)
            assert set(np.round(raw_of(df, booster), 9)) == {0.0} if training.features else len(booster.trees) <= 2
    wide = df.select("y", *[F.lit(1.0).alias(f"f{k}") for k in range(5000)])
    with pytest.raises(ValueError, match="features"):
        boost([Training(wide, [f"f{k}" for k in range(5000)], "y")], Settings())


def test_many_values_are_binned_by_quantiles(spark):
    df = spark.range(5000).select(F.col("id").alias("i"), (F.col("id") * 1.0).alias("a"), (F.col("id") >= 1234).cast("double").alias("y"))
    [booster], _ = boost([Training(df, ["a"], "y")], Settings(iterations=30))
    assert len(booster.thresholds[0]) <= 254
    wrong = [i for i, r in enumerate(raw_of(df, booster)) if (r > 0) != (i >= 1234)]
    assert len(wrong) <= 20


def test_equal_gains_take_the_first(spark):
    sums = np.array([[-4.0, 4, 30], [4, 4, 30], [0, 0, 0]] * 2)
    s = best_split(sums, Shape(np.array([3, 3])), Settings())
    assert (s.feature, s.bin, s.missing_left) == (0, 0, False) and s.gain == pytest.approx(8)


@pytest.fixture
def shop_rows(source):
    def make(trail, n=400):
        rng = random.Random(8)
        return source(trail, "t", "k bigint, a double, y int", *[(i, rng.random(), int(rng.random() < 0.5)) for i in range(n)]).with_columns(
            {"y": F.when(F.col("a") > 0.5, 1).otherwise(F.when(F.col("k") % 10 == 0, 1).otherwise(0))}
        )

    return make


class Keep:
    """A step that keeps the key out of the features."""

    keep = ("k",)

    def fit(self, t):
        return self

    def transform(self, t):
        return t


def test_folds_in_one_pass_are_separate_fits(shop_rows):
    t = shop_rows(Trail())
    make = lambda: Learner([Keep()], "y", iterations=10)
    together = cross_validate(t, make, 3, key="k")
    from rowtrail.operators.split import with_folds

    folded = with_folds(t, 3, 0, "k", "f")
    for fold, value, n, base in together:
        test = folded.filter(F.col("f") == fold).drop("f")
        alone = make().fit(folded.filter(F.col("f") != fold).drop("f")).score(test).first()
        assert (alone["score"], alone["n"]) == (pytest.approx(value), n)
        assert base == pytest.approx(baseline(test, "y")) and value > base + 0.2
    with pytest.raises(ValueError, match="alike"):
        cross_validate_all(t, {"a": make, "b": lambda: Learner([Keep()], "y", iterations=9)}, 2, key="k")


def test_verdicts_tell_good_from_useless(shop_rows):
    t = shop_rows(Trail())
    good = Learner([Keep()], "y", iterations=10).fit(t).predict(t)
    assert {r["score_ok"] for r in verdicts(good, "y", margin=0.2).df.collect()} == {True}
    useless = good.with_columns({"prediction": F.lit(1.0), "probability": F.lit(0.9)})
    assert score(useless, "y").first()["score"] == pytest.approx(baseline(t, "y"))
    assert {r["score_ok"] for r in verdicts(useless, "y", margin=0.05).df.collect()} == {False}
    assert good.hidden == t.hidden


def test_rows_end_in_the_leaf_that_steps_lead_to():
    rng = np.random.default_rng(3)
    bins, missing = rng.integers(0, 6, (3, 500), dtype=np.uint8), np.array([5, 5, 5])
    tree = boosting.Tree(
        np.array([0, 1, 2, 0, 0, 0, 0]), np.array([2, 1, 3, 0, 0, 0, 0]), np.array([True, False, True, False, False, False, False]),
        np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), np.arange(7.0),
    )
    node = np.zeros(500, np.int64)
    for _ in range(2):
        node = tree.step(bins, missing, node)
    assert (tree.leaves_of(bins, missing) == node).all()
    assert tree.leaves_of(bins[:, :0], missing).shape == (0,)


def test_the_sums_of_all_levels_stay_small_for_the_driver():
    settings = boosting.Settings()
    assert boosting.DIRECT_BYTES * settings.iterations * settings.depth < 500 << 20


def test_features_of_few_bins_are_summed_together():
    rng = np.random.default_rng(5)
    shape = Shape(np.array([3, 256, 3, 12, 3, 3, 3, 3, 3, 3, 3]))
    bins = np.array([rng.integers(0, s, 3000) for s in shape.sizes], np.uint8)
    y, role, slot = rng.integers(0, 2, 3000).astype(float), rng.integers(0, 3, 3000).astype(np.uint8), rng.integers(-1, 4, 3000)
    block = boosting.Block(0, bins, y, role, rng.normal(size=3000))
    got = boosting.node_sums("classifier", block, slot, 4, shape)
    g, h = boosting.gradients("classifier", y, block.raw)
    want = np.zeros((4, shape.total, 3))
    for i in np.flatnonzero((role == boosting.TRAIN) & (slot >= 0)):
        want[slot[i], shape.offsets + bins[:, i]] += [g[i], h[i], 1]
    assert np.allclose(got, want, atol=1e-12) and (got[..., 2] == want[..., 2]).all()
    assert sorted(sum(boosting.bundles(shape), [])) == list(range(11)) and len(boosting.bundles(shape)) <= 4
    block.codes = boosting.combined(bins, shape)
    assert (boosting.node_sums("classifier", block, slot, 4, shape) == got).all()


def test_best_split_is_that_of_all_features_at_once():
    """Features of few and of many bins, some of them alike: the first of equal gains, whichever width it has."""
    few = np.array([[-4.0, 4, 30], [4, 4, 30], [0, 0, 0]])
    wide = np.vstack([few[:2], np.zeros((30, 3))])
    for parts, first in (([few, wide], 0), ([wide, few], 0), ([np.vstack([[[0, 8, 60]], np.zeros((31, 3))]), wide, few], 1)):
        s = best_split(np.vstack(parts), Shape(np.array([len(p) for p in parts])), Settings())
        assert s.feature == first and s.gain == pytest.approx(8)
    better = few * [2, 1, 1]
    s = best_split(np.vstack([wide, better, few]), Shape(np.array([32, 3, 3])), Settings())
    assert s.feature == 1


def test_a_job_adds_one_tree_of_each_model_at_most(spark, monkeypatch):
    added = []
    stored_again = boosting._stored_again

    def counted(since, missing):
        added.append(max(map(len, since.values())))
        return stored_again(since, missing)

    monkeypatch.setattr(boosting, "_stored_again", counted)
    rows, y = numbers()
    boost([Training(framed(spark, rows, y), ["a", "b", "c"], "y")], Settings("regressor", iterations=4, depth=2), one_task_bytes=0)
    assert set(added) == {1}


def test_blocks_hold_more_rows_than_an_arrow_batch(spark):
    df = spark.range(0, 25_000, 1, 1).select((F.col("id") % 7 * 1.0).alias("a"), (F.col("id") % 2).alias("y"))
    booster, blocks = boosting._prepared(Training(df, ["a"], "y"), Settings(), 0)
    [block] = blocks.collect()
    assert block["rows"] == 25_000 and len(block["bins"]) == 25_000 and len(block["y"]) == 8 * 25_000


def test_folds_are_prepared_side_by_side(shop_rows):
    """Each fold's steps wait until those of another fold have begun; one after the other, they would wait in vain."""
    begun = threading.Barrier(2, timeout=60)

    class Meet(Keep):
        def fit(self, t):
            begun.wait()
            return self

    t = shop_rows(Trail(), 60)
    found = cross_validate(t, lambda: Learner([Meet()], "y", iterations=1), 2, key="k")
    assert [fold for fold, *_ in found] == [0, 1] and sum(n for _, _, n, _ in found) == 60
