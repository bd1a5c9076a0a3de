"""Sums over the combinations of bins that occur, blocks put together for one task, and values counted in one pass."""

import numpy as np
from pyspark.sql import functions as F

from rowtrail.features import boosting
from rowtrail.features.boosting import TEST, TRAIN, VALID, Block, Settings, Shape, Training


def test_flags_of_one_column_are_summed_together():
    rng = np.random.default_rng(3)
    n, kinds = 5000, rng.integers(0, 40, 5000)
    bins = np.array([*[(kinds == k) for k in range(40)], kinds % 7, rng.integers(0, 250, n)], np.uint8)
    shape = Shape(np.array([3] * 40 + [8, 256]))
    block = Block(0, bins, rng.integers(0, 2, n).astype(float), np.full(n, TRAIN, np.uint8), rng.normal(size=n))
    slot = rng.integers(-1, 5, n)
    plain = boosting.node_sums("classifier", block, slot, 5, shape)
    block.packs = boosting.packed(bins, shape)
    assert len(block.packs) == 2 < len(boosting.bundles(shape)) and len(block.packs[0].cells[0]) == 40
    got = boosting.node_sums("classifier", block, slot, 5, shape)
    assert (got[..., 2] == plain[..., 2]).all() and np.allclose(got, plain, atol=1e-9)
    block.derived = boosting.gradients("classifier", block.y, block.raw)
    assert (boosting.node_sums("classifier", block, slot, 5, shape) == got).all()
    empty = boosting.packed(bins[:, :0], shape)
    assert sorted(f for p in empty for f in p.features) == list(range(42))


def test_training_rows_come_first():
    rng = np.random.default_rng(4)
    parts = []
    for n in (7, 0, 12):
        role = rng.choice([TRAIN, TEST, VALID], n).astype(np.uint8)
        y = rng.normal(size=n)
        parts.append(Block(2, np.array([y > 0, role], np.uint8).reshape(2, n), y, role, y * 2))
    whole, n_train = boosting._together(2, parts)
    assert (whole.role[:n_train] == TRAIN).all() and (whole.role[n_train:] != TRAIN).all() and len(whole.y) == 19
    assert sorted(whole.y) == sorted(np.concatenate([p.y for p in parts]))
    assert (whole.raw == whole.y * 2).all() and (whole.bins == np.array([whole.y > 0, whole.role])).all()


def test_thresholds_of_many_features_take_one_pass(spark):
    rows = [([float(i % 3), None if i % 5 else float(i), float(i), None],) for i in range(2000)]
    values = spark.createDataFrame(rows, "xs array<double>").repartition(5)
    few, fives, wide, none = boosting.bin_thresholds(values, 4)
    assert few.tolist() == [0.5, 1.5] and len(none) == 0
    assert 250 <= len(fives) <= 255 and 250 <= len(wide) <= 255
    clear = spark.createDataFrame([([float(i % 190), float(i % 400)],) for i in range(2000)], "xs array<double>").repartition(7)
    exact, quantiles = boosting.bin_thresholds(clear, 2)
    assert exact.tolist() == [i + 0.5 for i in range(189)]  # middles between all values
    assert set(quantiles.tolist()) <= {float(i) for i in range(400)}


def test_a_packed_model_is_the_same(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), float(x), float(x + 3 * (k % 3) + e)) for k, x, e in zip(rng.integers(0, 12, 900), rng.normal(size=900), rng.normal(size=900))]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    df = df.select(*[(F.col("k") == k).cast("int").alias(f"k{k}") for k in range(12)], "x", "y")
    trees = []
    for pack_bytes in (0, 1 << 30):
        [booster], _ = boosting.boost([Training(df, df.columns[:-1], "y")], Settings("regressor", iterations=6, depth=3), pack_bytes=pack_bytes)
        trees.append([(t.feature.tolist(), t.bin.tolist(), np.round(t.value, 9).tolist()) for t in booster.trees])
    assert trees[0] == trees[1] and len(trees[0]) == 6
