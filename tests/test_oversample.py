"""Balanced classes by copies and made rows: sizes, values and lineage against plain Python."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowtrail import Trail, aggregate
from rowtrail.operators import lineage, oversample

POINTS = [(i, "big", float(i * 7 % 30), float(i % 4)) for i in range(23)] + [
    (23, "few", 1.0, 5.0), (24, "few", None, 6.0), (25, "few", 1.0, 5.0), (26, "few", 9.0, 0.0), (27, "one", 3.0, 3.0), (28, None, 2.0, 2.0), (29, None, 4.0, None),
]


@pytest.fixture
def points(spark):
    df = spark.createDataFrame(POINTS, "n bigint, c string, x double, y double")
    return Trail().source(df, "p", row_key="n", unique=True)


def lineage_of(t):
    rows = lineage.consolidate(t).collect()
    return [(r["n"], r["c"], r["x"], r["y"], r["made"], [p & ((1 << 48) - 1) for p in r["_prov"]]) for r in rows]


def curve(row):
    lows, highs = (0.0, 0.0), (29.0, 6.0)
    place = 0
    for i in range(2):
        v = row[2 + i]
        cell = 0 if v is None else int((v - lows[i]) / (highs[i] - lows[i]) * 65535)
        for b in range(16):
            place |= (cell >> b & 1) << (2 * b + i)
    return place


def test_neighbours_like_plain_python(points):
    got = sorted(lineage_of(oversample.neighbour_sample(points, "c", ["x", "y"], neighbours=2, key="n")), key=str)
    ranked = sorted(POINTS, key=lambda r: (r[1] is not None, r[1] or "", curve(r), str(r[0])))
    want = [(*r, 0, [r[0]]) for r in POINTS]
    for c in {r[1] for r in POINTS}:
        places = [p for p, r in enumerate(ranked) if r[1] == c]
        n = len(places)
        for j in range(23 - n):
            p, q = places[j % n], places[(j % n + (j // n) % min(2, max(n - 1, 1)) + 1) % n]
            a, b = ranked[p], ranked[q]
            u = int(hashlib.md5(f"0:{p}:{q}:{j + 1}".encode()).hexdigest()[:8], 16) / 2**32
            values = [v if v is None or w is None else v + (w - v) * u for v, w in zip(a[2:], b[2:])]
            want.append((a[0], c, *values, j + 1, sorted({a[0], b[0]})))
    assert got == sorted(want, key=str)
    assert Counter(r[1] for r in got) == {"big": 23, "few": 23, "one": 23, None: 23}


def test_copies(points):
    got = lineage_of(oversample.copy_sample(points, "c", key="n"))
    assert Counter(r[1] for r in got) == {"big": 23, "few": 23, "one": 23, None: 23}
    given = {r[0]: r for r in POINTS}
    assert all((*given[r[0]],) == r[:4] and r[5] == [r[0]] for r in got)
    times = Counter(r[0] for r in got)
    assert times[27] == 23 and sorted(times[i] for i in (23, 24, 25, 26)) == [5, 6, 6, 6]
    assert all(sorted(r[4] for r in got if r[0] == i) == list(range(times[i])) for i in times)


def test_many_rows_from_one(spark, monkeypatch):
    monkeypatch.setattr(oversample, "CHUNK", 100)
    df = spark.range(1001).select(F.col("id").alias("n"), F.when(F.col("id") == 0, "rare").otherwise("often").alias("c"))
    made = oversample.copy_sample(Trail().source(df, "t", row_key="n", unique=True), "c")
    rare = made.df.filter("c = 'rare'")
    assert rare.count() == 1000 and rare.agg(F.countDistinct("made"), F.max("made")).first()[:] == (1000, 999)


def test_groups_and_empty(points):
    groups = aggregate(points, ["c", "y"], dropna=False, x=("x", "sum"))
    made = oversample.neighbour_sample(groups.select("c", "y", "x"), "c", ["x"])
    sizes = {r["c"]: r["count"] for r in made.df.groupBy("c").count().collect()}
    assert set(sizes.values()) == {4}
    # a made row of two groups has the rows of both behind it; only class one has a single parent
    ones = lineage.consolidate(made.filter("c = 'one' AND made > 0")).collect()
    assert len(ones) == 3 and all(len(r["_prov"]) == 1 for r in ones)
    assert all(len(r["_prov"]) >= 2 for r in lineage.consolidate(made.filter("c = 'few' AND made > 0")).collect())
    empty = points.filter("n < 0")
    assert oversample.copy_sample(empty, "c").df.count() == 0
    assert oversample.neighbour_sample(empty, "c", ["x", "y"]).df.count() == 0


def test_refused(points):
    with pytest.raises(ValueError):
        oversample.copy_sample(points, "nothing")
    with pytest.raises(ValueError):
        oversample.copy_sample(points, "c", name="x")
    with pytest.raises(ValueError):
        oversample.neighbour_sample(points, "c", [])
