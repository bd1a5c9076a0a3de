"""Gamma-Poisson factorisation beside plain numpy on dense tables."""

import numpy as np
from pyspark.sql import functions as F

from rowtrail import Trail
from rowtrail.features.encoding import GapEncoder
from rowtrail.features.factorise import SCALE, SHAPE, TINY, activations, first_weights, fitted_weights, gram_counts

WORDS = ["blue widget", "blue gadget", "pale gadget", "pale widget!", "old door", "old doors", "new door", "", None, "x", "éé 中文", "blue widget"] + [f"item {i % 9} of {i}" for i in range(60)]


def dense(counts, buckets):
    rows = counts.orderBy("key").collect()
    x = np.zeros((len(rows), buckets))
    for i, r in enumerate(rows):
        np.add.at(x[i], r["codes"], 1 if r["times"] is None else r["times"])
    return [r["key"] for r in rows], x


def step(x, h, w):
    return (h * ((x / (h @ w + TINY)) @ w.T) + SHAPE - 1) / (w.sum(1) + 1 / SCALE)


def test_rounds_are_those_of_numpy(spark):
    df = spark.createDataFrame([(s,) for s in WORDS], "s string").repartition(4)
    counts = gram_counts(df, "s", 2, 4, 64).cache()
    keys, x = dense(counts, 64)
    assert len(keys) == len({(s or "").lower() for s in WORDS})
    found = fitted_weights(counts, 5, 64, rounds=8, steps=3)
    w = first_weights(counts, 5, 64)
    h = np.repeat(np.maximum(x.sum(1, keepdims=True) / 5, TINY), 5, 1)
    losses = []
    for _ in range(8):
        for _ in range(3):
            h = step(x, h, w)
        mean = h @ w + TINY
        losses.append((mean - TINY).sum() - (x * np.log(mean)).sum() + (h / SCALE - (SHAPE - 1) * np.log(h + 1e-300)).sum())
        w = w * (h.T @ (x / mean)) / h.sum(0)[:, None]
    assert np.allclose(found.matrix, w, rtol=1e-8)
    assert np.allclose(found.history, losses, rtol=1e-9)
    assert all(b < a for a, b in zip(losses, losses[1:]))
    active = {r["key"]: r["active"] for r in activations(counts, found, steps=4, enough=0.0).collect()}
    h = np.repeat(np.maximum(x.sum(1, keepdims=True) / 5, TINY), 5, 1)
    for _ in range(4):
        h = step(x, h, w)
    assert np.allclose([active[k] for k in keys], h, rtol=1e-8)
    counts.unpersist()


def test_encoder_on_rows(source):
    t = source(Trail(), "t", "i bigint, s string", *enumerate(WORDS))
    encoder = GapEncoder(["s"], 4, buckets=128).fit(t)
    rows = encoder.transform(t).df.orderBy("i").collect()
    assert len(rows) == len(WORDS) and rows[0][1:] is not None
    at = {r["i"]: np.array([r[f"s_{k}"] for k in range(4)]) for r in rows}
    assert (at[0] == at[11]).all() and (at[7] == at[8]).all()
    below = encoder.models["s"].below
    for i, s in enumerate(WORDS):
        n = len(s or "")
        assert abs(at[i] @ below - sum(max(n - k, 0) for k in (1, 2, 3)) - 4 * (SHAPE - 1)) < 1e-6
    # strings alike have activations alike
    near, far = np.linalg.norm(at[4] - at[5]), np.linalg.norm(at[4] - at[20])
    assert near < far


def test_empty_columns(source):
    t = source(Trail(), "t", "i bigint, s string", (0, None), (1, ""))
    encoder = GapEncoder(["s"], 3, buckets=16).fit(t)
    assert encoder.transform(t).df.count() == 2
    assert encoder.fit(t.filter(F.col("i") < 0)).transform(t).df.count() == 2
