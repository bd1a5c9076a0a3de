"""Weighted nearest keys beside brute force in plain Python, on every way the search can go."""

import math
import random
from collections import Counter

import pytest

from rowtrail.operators import weighted
from rowtrail.operators.weighted import nearest_keys

WAYS = (10**9, 0)


def grams(text):
    out = Counter()
    for word in (text or "").lower().split():
        padded = f" {word} "
        out.update(padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1))
    return out


def brute(left, right, texts, numbers, max_distance=None):
    names = [*texts, *numbers]
    left, right = ({tuple(r[c] for c in names) for r in side} for side in (left, right))
    left, right = ({k for k in side if any(v is not None for v in k)} for side in (left, right))
    order = sorted(right, key=lambda k: [(v is not None, v) for v in k])
    n, t = len(right), len(texts)
    df = [Counter(g for k in right for g in grams(k[i])) for i in range(t)]

    def vector(k, i):
        v = {g: c * (math.log((1 + n) / (1 + df[i][g])) + 1) for g, c in grams(k[i]).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / norm for g, x in v.items()}

    stats = []
    for j in range(len(numbers)):
        v = [k[t + j] for k in right if k[t + j] is not None]
        mean = sum(v) / len(v) if v else 0
        stats.append((mean, math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)) or 1 if v else 1))
    df = [Counter({g: sum(g in grams(k[i]) for k in right) for g in df[i]}) for i in range(t)]
    at = {k: ([vector(k, i) for i in range(t)], [0 if k[t + j] is None else (k[t + j] - m) / s for j, (m, s) in enumerate(stats)]) for k in left | right}
    out = {}
    for k in left:
        best = None
        for place, r in enumerate(order):
            (v, x), (w, z) = at[k], at[r]
            d2 = round(max(sum(2 - 2 * sum(a * q.get(g, 0) for g, a in p.items()) for p, q in zip(v, w)), 0), 9)
            d2 = 0.0 if k == r else d2 + round(sum((a - b) ** 2 for a, b in zip(x, z)), 12)
            if best is None or (d2, k != r, place) < best[:3]:
                best = (d2, k != r, place, r)
        if best and (max_distance is None or best[0] <= max_distance**2 + 1e-9):
            out[k] = (best[3], math.sqrt(best[0]))
    return out


def check(spark, left, right, texts, numbers, max_distance=None, ways=WAYS):
    schema = ", ".join([f"{c} string" for c in texts] + [f"{c} double" for c in numbers])
    frames = [spark.createDataFrame([tuple(r[c] for c in [*texts, *numbers]) for r in side], schema) for side in (left, right)]
    want = brute(left, right, texts, numbers, max_distance)
    for way in ways:
        found = nearest_keys(*frames, texts, numbers, max_distance, way).collect()
        got = {tuple(r[f"l_{c}"] for c in [*texts, *numbers]): (tuple(r[f"r_{c}"] for c in [*texts, *numbers]), r["distance"]) for r in found}
        assert len(found) == len(got) and got.keys() == want.keys()
        for k, (r, d) in want.items():
            assert got[k][0] == r and got[k][1] == pytest.approx(d, abs=1e-4), (k, got[k], (r, d))


def said(rng):
    return rng.choice(["red", "Blue", "GREEN", "pale", "é", "x"]) + rng.choice([" ", "  "]) + rng.choice(["door", "floor", "moor", "doors", "window 12", "中文 字"])


def test_texts(spark):
    rng = random.Random(1)
    left = [{"a": said(rng) + rng.choice(["", "s", "!"])} for _ in range(60)] + [{"a": x} for x in (None, "", "  ", "zzz", "RED DOOR", "red door")]
    right = [{"a": said(rng)} for _ in range(40)] + [{"a": "red door"}, {"a": None}, {"a": ""}]
    check(spark, left, right, ["a"], [])
    check(spark, left, right, ["a"], [], 0.7)


def test_texts_and_numbers(spark):
    rng = random.Random(2)

    def row():
        return {"a": rng.choice([said(rng), said(rng), None]), "b": rng.choice(["north", "south", "nord", ""]), "x": rng.choice([None, rng.gauss(0, 5), rng.gauss(900, 1)])}

    left, right = [row() for _ in range(50)], [row() for _ in range(40)]
    check(spark, left, right, ["a", "b"], ["x"])
    far = [{"a": "qqq", "x": 1e6}, {"a": "qqq", "x": -1e6}, {"a": None, "x": 3.0}]
    check(spark, far, [{"a": r["a"], "x": r["x"]} for r in right], ["a"], ["x"])


def test_numbers(spark):
    rng = random.Random(3)
    crowd = [{"x": 1 + rng.random() / 1000, "y": 2.0} for _ in range(150)] + [{"x": float(i), "y": float(-i)} for i in range(0, 100, 9)]
    left = [{"x": rng.gauss(1, 1e-4), "y": 2.0} for _ in range(40)] + [{"x": 5e5, "y": -3e5}, {"x": None, "y": 7.0}, {"x": None, "y": None}]
    check(spark, left, crowd, [], ["x", "y"], ways=(10**9, 20))
    check(spark, left, [{"x": 4.0, "y": 4.0}] * 3, [], ["x", "y"], ways=(0,))
    check(spark, left, crowd, [], ["x", "y"], 0.01, ways=(20,))


def test_empty_sides(spark):
    rows = [{"a": "one", "x": 1.0}]
    check(spark, rows, [], ["a"], ["x"])
    check(spark, [], rows, ["a"], ["x"])


@pytest.mark.parametrize("pairs", [10**6, 0])
def test_few_texts_with_many_numbers(spark, monkeypatch, pairs):
    """Texts are compared once for all keys that have them; without that, the joins on grams find the same."""
    monkeypatch.setattr(weighted, "TEXT_PAIRS", pairs)
    if pairs:
        for name in ("reaching", "all_common"):  # keys by keys with a common gram: grows with the product of both sides
            monkeypatch.setattr(weighted._Search, name, None)
    r = random.Random(5)
    towns = ["north town", "south town", "nord town", "hill", None]
    left = [{"a": r.choice([*towns, "qqq", "hills"]), "x": r.choice([None, r.randint(-50, 50) / 4])} for _ in range(80)]
    right = [{"a": r.choice(towns), "x": r.choice([None, r.randint(-40, 40) / 4])} for _ in range(60)]
    found = nearest_keys(*[spark.createDataFrame([(k["a"], k["x"]) for k in side], "a string, x double") for side in (left, right)], ["a"], ["x"], None, 50)
    got = {(row["l_a"], row["l_x"]): (row["r_a"], row["r_x"], round(row["distance"], 4)) for row in found.collect()}
    expected = {k: (*v[0], round(v[1], 4)) for k, v in brute(left, right, ["a"], ["x"]).items()}
    assert got == expected
