"""Nearest rows by weighted n-grams of text keys and by numbers.

Each text column of a key is a unit vector: counts of the 2- to 4-grams of its words (lower case, a blank at both ends of a word), weighed by inverse
document frequency ``ln((1 + n) / (1 + df)) + 1`` over the distinct right keys. Each number is taken from its mean over them and divided by its standard
deviation; NULL stands for the mean. The distance is that of points: the root of ``2 - 2 cos``, summed over the text columns, and of the squared
differences of the numbers. For every left key the nearest right key is found exactly; of right keys at the same distance an equal one, then the smallest.
Squared distances are told apart to nine digits for texts and twelve for numbers. Keys that are equal are at distance 0.

Only distinct keys are compared, and equal keys meet first. While the join on grams is small (its size is counted first), products are simply added
up. Beyond that the radius grows round by round: grams are ordered from rare to frequent, and of every gram of a key the norm of its vector from that gram on is
known. Two vectors whose product reaches t have a first common gram, and there the product of both norms is at least t; so only grams whose norms can
reach t are joined on, which leaves frequent grams out while t is large. A left key is done when a right key lies within the radius.

A right key without a common gram can only be nearest by its numbers. It is found on a grid: keys meet those of the same and the neighbouring cells,
the width of the cells grows until the nearest one found is no farther than a cell is wide. Cells begin so small that crowded ones do not make many pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrail.functions.text import char_ngrams
from rowtrail.operators.joins import hidden_names, same_trail
from rowtrail.operators.tracked import Tracked
from rowtrail.sources.readers import spread
from rowtrail.sources.storage import store

LOW, HIGH = 2, 4  # fixed values: lengths of the grams
SHARES = (0.15, 0.35, 0.6, 0.8, 0.92, 1.0)
"""Radii of the rounds, as shares of the squared distance of texts without anything in common."""
SMALL_MEETINGS = 50_000_000
LEAST_WIDTH = 4e-6
"""Cells are no narrower: within them, squared distances cannot be told apart."""
TEXT_PAIRS = 250_000
"""With at most so many pairs of different texts, texts are compared once for all keys that have them, and numbers among the keys of a text."""
CELL_COLUMNS = 3
"""So many numbers make up the cells; the others only count in the distance."""


def word_grams(text: Column) -> Column:
    """The 2- to 4-grams of a text's words, each word with a blank on both sides; with repeats."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def grams(n: int) -> Column:
        return F.flatten(F.transform(words, lambda w: char_ngrams(F.concat(F.lit(" "), w, F.lit(" ")), n)))

    return F.coalesce(F.concat(*[grams(n) for n in range(LOW, HIGH + 1)]), F.array().cast("array<string>"))


def _numbered(keys: DataFrame, names: list[str]) -> DataFrame:
    """Distinct keys without those that are NULL in all columns, numbered in their order; written, so the numbers stay."""
    ordered = keys.distinct().na.drop(how="all", subset=names).orderBy(*names)
    return store(ordered.withColumn("id", F.monotonically_increasing_id()), "keys")


def _listed(keys: DataFrame, texts: list[str]) -> DataFrame:
    """(id, c, gram, tf): the different grams of each text column, told apart by its number."""
    parts = [spread(keys).select("id", F.lit(i).alias("c"), F.explode(word_grams(F.col(name))).alias("g")) for i, name in enumerate(texts)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("id", "c", F.concat_ws(":", F.col("c").cast("string"), "g").alias("gram")).agg(F.count(F.lit(1)).alias("tf"))


def _weighed(listed: DataFrame, idf: DataFrame, default: float, side: str) -> DataFrame:
    """Unit weights per text column (w), and the norm of the key's vector from each gram on (s), rare grams first."""
    rows = listed.join(idf, "gram", "left").withColumn("idf", F.coalesce("idf", F.lit(default))).withColumn("x", F.col("tf") * F.col("idf"))
    w = F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id", "c")))
    follow = Window.partitionBy("id").orderBy(F.desc("idf"), "gram").rowsBetween(0, Window.unboundedFollowing)
    norm = F.sqrt(F.sum(F.col(f"{side}w") * F.col(f"{side}w")).over(follow))
    out = rows.withColumn(f"{side}w", w).withColumn(f"{side}s", norm)
    return store(out.select(F.col("id").alias(f"{side}id"), "gram", f"{side}w", f"{side}s"), "weighed")


def _squared(pairs: list[tuple[str, str]]) -> Column:
    return F.round(reduce(lambda a, b: a + b, [(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in pairs]), 12)


def _of_texts(keys: DataFrame, texts: list[str]) -> DataFrame:
    """(id, texts…, keys): the different texts of the keys, numbered, and how many keys have them."""
    counted = keys.groupBy(*texts).agg(F.count(F.lit(1)).alias("keys"))
    return store(counted.withColumn("id", F.monotonically_increasing_id()), "texts")


@dataclass
class _Search:
    """Both sides' keys (lid or rid with scaled numbers x0…), their weighed grams, and the number of text columns."""

    left: DataFrame
    right: DataFrame
    left_grams: DataFrame | None
    right_grams: DataFrame | None
    texts: int
    numbers: int

    def best(self, products: DataFrame) -> DataFrame:
        """The nearest of the pairs (lid, rid, dot): (lid, rid, d2)."""
        d2 = F.round(F.greatest(F.lit(2.0 * self.texts) - 2 * F.col("dot"), F.lit(0.0)), 9)
        if self.numbers:
            xs = [f"x{i}" for i in range(self.numbers)]
            products = products.join(self.left.select("lid", *[F.col(x).alias(f"l{x}") for x in xs]), "lid")
            products = products.join(self.right.select("rid", *[F.col(x).alias(f"r{x}") for x in xs]), "rid")
            d2 = d2 + _squared([(f"l{x}", f"r{x}") for x in xs])
        nearest = products.select("lid", F.struct(d2.alias("d2"), "rid").alias("m"))
        return nearest.groupBy("lid").agg(F.min("m").alias("m")).select("lid", "m.rid", "m.d2")

    def meetings(self, open_: DataFrame) -> int:
        sides = [df.groupBy("gram").agg(F.count(F.lit(1)).alias(n)) for df, n in ((self.left_grams.join(open_, "lid", "left_semi"), "a"), (self.right_grams, "b"))]
        return sides[0].join(sides[1], "gram").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0

    def all_common(self, open_: DataFrame) -> DataFrame:
        """The best of all pairs with a common gram, products added up gram by gram."""
        met = self.left_grams.join(open_, "lid", "left_semi").join(self.right_grams, "gram")
        return self.best(met.groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("dot")))

    def reaching(self, open_: DataFrame, t: float) -> DataFrame:
        """The best of the pairs whose product may reach ``t``."""
        norm = math.sqrt(self.texts)
        some = self.left_grams.filter(F.col("ls") >= t / norm - 1e-9).join(open_, "lid", "left_semi")
        met = some.join(self.right_grams.filter(F.col("rs") >= t / norm - 1e-9), "gram")
        pairs = met.filter(F.col("ls") * F.col("rs") >= t - 1e-9).select("lid", "rid").distinct()
        products = pairs.join(self.left_grams.select("lid", "gram", "lw"), "lid").join(self.right_grams.select("rid", "gram", "rw"), ["rid", "gram"])
        return self.best(products.groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("dot")))

    def nearest_numbers(self, open_: DataFrame, meetings: int) -> DataFrame:
        """(lid, rid, d2) of the right key with the nearest numbers, as if it had no common gram."""
        everything = F.lit(0).cast("long").alias("t")
        found = self.nearest_within(self.left.join(open_, "lid", "left_semi").select("*", everything), self.right.select("*", everything), meetings)
        return found.select("lid", "rid", (F.col("d2") + 2.0 * self.texts).alias("d2"))

    def nearest_within(self, wanted: DataFrame, right: DataFrame, meetings: int) -> DataFrame:
        """(lid, t, rid, d2) of the right key with the nearest numbers of those with the same ``t``; ``wanted`` has lid, t and the numbers."""
        xs = [f"x{i}" for i in range(self.numbers)]
        cells = xs[:CELL_COLUMNS]
        right = store(right.groupBy("t", *xs).agg(F.min("rid").alias("rid")), "numbers")
        todo = store(wanted.select("lid", "t", *xs).join(right.select("t").distinct(), "t", "left_semi"), "numbers")
        largest = right.groupBy("t").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar().alias("n")
        low_high = right.agg(*[F.min(x) for x in cells], *[F.max(x) for x in cells], largest).first()
        k = len(cells)
        if low_high["n"] is None:
            return todo.select("lid", "t", F.lit(0).cast("long").alias("rid"), F.lit(0.0).alias("d2")).limit(0)
        span = max(max(low_high[k + i] - low_high[i] for i in range(k)), 1e-9)
        width = max(span / max(low_high["n"], 1) ** (1 / k), LEAST_WIDTH)

        def cell(x: str, shift: int) -> Column:
            return (F.floor(F.col(x) / width) + shift).alias(f"c{x}")

        def met(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
            near = [F.struct("t", *[cell(x, d) for x, d in zip(cells, shift, strict=True)]) for shift in product((-1, 0, 1), repeat=k)]
            return rows.withColumn("cell", F.explode(F.array(*near))), right.withColumn("cell", F.struct("t", *[cell(x, 0) for x in cells]))

        def pairs_of(rows: DataFrame) -> int:
            sides = [df.groupBy("cell").agg(F.count(F.lit(1)).alias(n)) for df, n in zip(met(rows), "ab", strict=True)]
            return sides[0].join(sides[1], "cell").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0

        while width > LEAST_WIDTH * 8 and pairs_of(todo) > meetings:
            width /= 8
        found = []
        while not todo.isEmpty():
            if width > 2 * span:  # far outside: the cells' width no longer follows the right keys, so begin from the farthest left key
                far = todo.agg(*[F.max(F.abs(x)) for x in cells]).first()
                width = max(width, *[2 * v for v in far])
            ls, rs = met(todo)
            rs = rs.select("cell", F.col("rid"), *[F.col(x).alias(f"r{x}") for x in xs])
            d2 = _squared([(x, f"r{x}") for x in xs])
            near = ls.join(rs, "cell").select("lid", "t", F.struct(d2.alias("d2"), "rid").alias("m"))
            near = near.groupBy("lid", "t").agg(F.min("m").alias("m")).select("lid", "t", "m.rid", "m.d2").filter(F.col("d2") + 2e-12 <= width * width)
            found.append(store(near, "matches"))
            todo = store(todo.join(found[-1], ["lid", "t"], "left_anti"), "numbers")
            width *= 4
        if not found:
            return todo.select("lid", "t", F.lit(0).cast("long").alias("rid"), F.lit(0.0).alias("d2")).limit(0)
        return reduce(DataFrame.unionByName, found)

    def nearest_by_texts(self, open_: DataFrame, pairs: DataFrame, meetings: int) -> DataFrame:
        """(lid, rid, d2) for keys that have few different texts (``t`` of both sides): ``pairs`` (lt, t, dt) has all squared distances of texts.

        The nearest numbers are looked for among the keys with the nearest text first; what they reach leaves few other texts.
        """
        wanted = store(self.left.join(open_, "lid", "left_semi").withColumnRenamed("t", "lt"), "wanted")
        nearest = pairs.groupBy("lt").agg(F.min(F.struct("dt", "t")).alias("m")).select("lt", "m.t", "m.dt")

        def reached(candidates: DataFrame) -> DataFrame:
            near = self.nearest_within(candidates, self.right, meetings)
            near = near.join(candidates.select("lid", "t", "dt"), ["lid", "t"])
            return store(near.select("lid", "rid", "t", (F.col("dt") + F.col("d2")).alias("d2")), "matches")

        first = reached(wanted.join(F.broadcast(nearest), "lt"))
        bounds = first.select("lid", F.col("t").alias("first_t"), F.col("d2").alias("bound"))
        others = wanted.join(bounds, "lid").join(F.broadcast(pairs), "lt")
        others = store(others.filter((F.col("t") != F.col("first_t")) & (F.col("dt") <= F.col("bound") + 1e-9)), "wanted")
        both = first.unionByName(reached(others)).select("lid", F.struct("d2", "rid").alias("m"))
        return both.groupBy("lid").agg(F.min("m").alias("m")).select("lid", "m.rid", "m.d2")


def nearest_keys(
    left_keys: DataFrame, right_keys: DataFrame, texts: list[str], numbers: list[str], max_distance: float | None = None, small_meetings: int = SMALL_MEETINGS
) -> DataFrame:
    """(l_…, r_…, distance): of each distinct left key the nearest right key; both sides have the columns ``texts`` and ``numbers``."""
    names = [*texts, *numbers]
    left, right = _numbered(left_keys, names), _numbered(right_keys, names)
    farthest = float("inf") if max_distance is None else max_distance**2 + 1e-9
    n = right.count()
    scaled = {}
    if numbers and n:
        stats = right.agg(*[f(c).alias(f"{i}{k}") for i, c in enumerate(numbers) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        for i, c in enumerate(numbers):
            mean, spread_ = stats[f"{i}m"] or 0.0, stats[f"{i}s"] or 1.0
            scaled[f"x{i}"] = F.coalesce((F.col(c).cast("double") - mean) / spread_, F.lit(0.0))
    grams = [None, None]
    by_texts = texts and numbers and n
    if by_texts:
        of_texts = [_of_texts(side, texts) for side in (left, right)]
        by_texts = of_texts[0].count() * of_texts[1].count() <= TEXT_PAIRS
    if texts and n:
        # a gram counts once for every right key, also where many keys have the same texts
        weighing = of_texts if by_texts else [left, right.withColumn("keys", F.lit(1))]
        listed = store(_listed(weighing[1], texts), "grams")
        df = listed.join(weighing[1].select("id", "keys"), "id").groupBy("gram").agg(F.sum("keys").alias("df"))
        idf = store(df.select("gram", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
        default = math.log(1 + n) + 1
        grams = [_weighed(_listed(weighing[0], texts), idf, default, "l"), _weighed(listed, idf, default, "r")]
    placed = [left, right]
    if by_texts:
        same_texts = [reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in texts])] * 2
        placed = [
            side.alias("a").join(F.broadcast(t.alias("b")), same).select("a.*", F.col("b.id").alias("t"))
            for side, t, same in zip(placed, of_texts, same_texts, strict=True)
        ]
    kept = ["t"] if by_texts else []
    sides = [side.select(F.col("id").alias(name), *kept, *[x.alias(c) for c, x in scaled.items()]) for side, name in zip(placed, ("lid", "rid"), strict=True)]
    search = _Search(*sides, *grams, len(texts), len(scaled))

    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names])
    equal = left.alias("l").join(right.alias("r"), same).select(F.col("l.id").alias("lid"), F.col("r.id").alias("rid"), F.lit(0.0).alias("d2"))
    found = [store(equal, "matches")]
    open_ = store(left.select(F.col("id").alias("lid")).join(found[0], "lid", "left_anti"), "open")
    apart = 2.0 * len(texts)

    def settle(met: DataFrame, radius: float) -> None:
        nonlocal open_
        found.append(store(met.filter(F.col("d2") <= radius), "matches"))
        open_ = store(open_.join(found[-1], "lid", "left_anti"), "open")

    if by_texts:
        products = grams[0].join(grams[1], "gram").groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("dot"))
        all_pairs = of_texts[0].select(F.col("id").alias("lid")).crossJoin(of_texts[1].select(F.col("id").alias("rid"))).join(products, ["lid", "rid"], "left")
        dt = F.round(F.greatest(F.lit(apart) - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0)), 9)
        pairs = store(all_pairs.select(F.col("lid").alias("lt"), F.col("rid").alias("t"), dt.alias("dt")), "text_pairs")
        found.append(search.nearest_by_texts(open_, pairs, small_meetings).filter(F.col("d2") <= farthest))
        rest = found[0].limit(0)
    elif texts and n:
        if search.meetings(open_) <= small_meetings:
            pending = store(search.all_common(open_), "pending")
            settle(pending, min(apart, farthest))
        else:
            for share in SHARES[:-1]:
                radius = min(apart * share, farthest)
                settle(search.reaching(open_, len(texts) - radius / 2), radius)
                if radius >= farthest or open_.isEmpty():
                    break
            pending = store(search.reaching(open_, 1e-9) if farthest > apart * SHARES[-2] else found[0].limit(0), "pending")
            settle(pending, min(apart, farthest))
        # beyond ``apart``, a right key without a common gram may be nearer than the best with one
        rest = pending.join(open_, "lid", "left_semi")
    else:
        rest = found[0].limit(0)
    if n and not by_texts and farthest >= apart and not open_.isEmpty():
        if numbers:
            rest = rest.unionByName(search.nearest_numbers(open_, small_meetings))
        else:
            rest = open_.select("lid", right.agg(F.min("id")).scalar().alias("rid"), F.lit(apart).alias("d2"))
        nearest = rest.groupBy("lid").agg(F.min(F.struct("d2", "rid")).alias("m")).select("lid", "m.rid", "m.d2")
        found.append(nearest.filter(F.col("d2") <= farthest))

    ls = left.select(F.col("id").alias("lid"), *[F.col(c).alias(f"l_{c}") for c in names])
    rs = right.select(F.col("id").alias("rid"), *[F.col(c).alias(f"r_{c}") for c in names])
    out = reduce(DataFrame.unionByName, found).join(ls, "lid").join(rs, "rid")
    return out.select(*[f"l_{c}" for c in names], *[f"r_{c}" for c in names], F.sqrt("d2").alias("distance"))


def weighted_join(
    left: Tracked,
    right: Tracked,
    left_on: str | list[str],
    right_on: str | list[str],
    max_distance: float | None = None,
    suffix: str = "",
    match_info: bool = False,
    small_meetings: int = SMALL_MEETINGS,
) -> Tracked:
    """Left join with the nearest right row per left row. Key columns that are numbers on both sides are compared as numbers, the others as texts.

    Rows farther than ``max_distance`` stay unmatched: NULL columns, no right ids; so do rows whose keys are all NULL. ``match_info`` adds
    ``match_distance`` and ``match_accepted``. Of right rows with the same key the one with the smallest id is taken.
    """
    same_trail(left, right)
    left_on = [left_on] if isinstance(left_on, str) else list(left_on)
    right_on = [right_on] if isinstance(right_on, str) else list(right_on)
    renamed = right.rename({c: c + suffix for c in right.columns}) if suffix else right
    clash = set(left.columns) & set(renamed.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}: give a suffix")
    both = [
        all(isinstance(t.df.schema[c].dataType, T.NumericType) for t, c in ((left, a), (right, b))) for a, b in zip(left_on, right_on, strict=True)
    ]
    kinds = ["double" if number else "string" for number in both]
    keys = [f"k{i}" for i in range(len(kinds))]

    def keyed(t: Tracked, columns: list[str]) -> list[Column]:
        out = [F.col(c).cast(kind) for c, kind in zip(columns, kinds, strict=True)]
        return [F.when(~F.isnan(x), x) if kind == "double" else x for x, kind in zip(out, kinds, strict=True)]

    named = [t.df.select(*[x.alias(k) for x, k in zip(keyed(t, on), keys, strict=True)]) for t, on in ((left, left_on), (right, right_on))]
    texts, numbers = ([k for k, kind in zip(keys, kinds, strict=True) if kind == want] for want in ("string", "double"))
    matches = nearest_keys(*named, texts, numbers, max_distance, small_meetings)
    own = dict(zip([f"_r{k}" for k in keys], keyed(renamed, [c + suffix for c in right_on]), strict=True))
    one_per_key = renamed.with_columns(own).first_per_key(list(own))
    hidden = hidden_names(left, one_per_key)
    right_df = one_per_key.df.withColumnsRenamed(hidden)
    to_row = [F.col(f"r_{k}").eqNullSafe(F.col(f"_r{k}")) for k in keys]
    to_key = [x.eqNullSafe(F.col(f"l_{k}")) for x, k in zip(keyed(left, left_on), keys, strict=True)]
    found = matches.join(right_df, reduce(lambda a, b: a & b, to_row)).drop(*own)
    joined = left.df.join(found, reduce(lambda a, b: a & b, to_key), "left")
    info = [F.col("distance").alias("match_distance"), F.col("distance").isNotNull().alias("match_accepted")] if match_info else []
    df = joined.select(*left.columns, *renamed.columns, *info, *left.hidden, *hidden.values())
    nodes = left.nodes | {hidden[c]: node for c, node in right.nodes.items()}
    return replace(left, df=df, nodes=nodes, fresh=None, exact=False)
