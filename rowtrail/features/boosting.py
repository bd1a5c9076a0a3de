"""Gradient boosting of regression trees over histograms.

Rows are binned once: every feature becomes a byte, with a bin of its own for missing values, and about a megabyte of rows is one block, a row of a
stored table. A level of a tree is one job: each task adds up gradients, second derivatives and counts of its blocks per (model, node, feature, bin),
and only these sums travel. A split looks at all bins of all features and at both sides for the missing values. Several models, as those of the folds
of a cross-validation, grow in the same jobs: the model is one more key of the sums.

What a task needs of the trees comes with the job. The first level of a round adds the tree of the round before to the scores and keeps them, so a task applies
the growing tree and at most one other, however many there are. Every ``STORE_EVERY`` rounds the scores are stored, so a lost executor costs few trees. Models whose
blocks were counted to be small (``ONE_TASK_BYTES``) skip the jobs: each grows in a task of its own, through the same sums and splits. Features of few bins, as flags
are, are summed several at a time: over the combinations of their bins, of which the sums of each are then taken.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtrail.sources.storage import side_by_side, store

MAX_BINS = 255  # fixed value: bins of a feature, beside the one for missing values
MAX_FEATURES = 4096
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1 << 17
STORE_EVERY = 10
MOST_CELLS = 2048
"""Combinations of bins over which features are summed together, at most."""
DIRECT_BYTES = 1 << 19
"""A level's sums of all tasks up to this size are added up by the driver; larger ones in a second stage, which also chooses the splits.

A model has hundreds of levels: all their sums together must stay small for the driver, too."""
ONE_TASK_BYTES = 96 << 20
"""A model with at most so many bytes of blocks grows in one task: the many short jobs would take longer than the sums."""
PACK_BYTES = 32 << 20
"""From so many bytes of bins on, finding the combinations that occur pays. It changes the order of sums, and so which of two splits that are equal up to rounding is taken."""
TRAIN, TEST, VALID = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """The customary defaults: 100 rounds of at most 31 leaves with 20 rows each.

    ``early_stopping``: a tenth of the rows is held out, and a model is done when the last ``patience`` rounds have not lowered its loss there;
    None does so from ``AUTO_ROWS`` training rows on.
    """

    kind: str = "classifier"
    iterations: int = 100
    depth: int = 5
    leaves: int = 31
    rate: float = 0.1
    least_rows: int = 20
    least_hessian: float = 1e-3
    l2: float = 0.0
    early_stopping: bool | None = None
    patience: int = 10


AUTO_ROWS = 10_000


@dataclass
class Tree:
    """Nodes as arrays; a leaf has ``left`` -1."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves_of(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The node in which each row ends; ``bins`` is (features, rows)."""
        out = np.zeros(bins.shape[1], np.int64)
        todo: list[tuple[int, np.ndarray | None]] = [(0, None)]  # a node and its rows, None: all
        while todo:
            node, rows = todo.pop()
            if self.left[node] < 0:
                out[slice(None) if rows is None else rows] = node
                continue
            f = self.feature[node]
            b = bins[f] if rows is None else bins[f][rows]
            to_left = b <= self.bin[node]
            lost = b == missing[f]
            to_left = to_left | lost if self.missing_left[node] else to_left & ~lost
            if rows is None:
                todo += [(self.left[node], np.flatnonzero(to_left)), (self.right[node], np.flatnonzero(~to_left))]
            else:
                todo += [(self.left[node], rows[to_left]), (self.right[node], rows[~to_left])]
        return out

    def step(self, bins: np.ndarray, missing: np.ndarray, node: np.ndarray) -> np.ndarray:
        """One level down from each row's node, where there is one."""
        f = self.feature[node]
        b = bins[f, np.arange(len(node))].astype(np.int64)
        to_left = np.where(b == missing[f], self.missing_left[node], b <= self.bin[node])
        return np.where(self.left[node] >= 0, np.where(to_left, self.left[node], self.right[node]), node)


@dataclass
class Booster:
    """A fitted model: thresholds of the bins, where boosting began, and its trees."""

    features: list[tuple[str, int]]  # column and its width: 1, or that of a vector
    thresholds: list[np.ndarray]
    kind: str
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(t) + 1 for t in self.thresholds], np.int64)

    def binned(self, values: list[pa.Array], rows: int) -> np.ndarray:
        """(features, rows) bytes of columns of numbers and of vectors."""
        columns = []
        for (_, width), array in zip(self.features, values, strict=True):
            array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
            flat = array.flatten() if pa.types.is_list(array.type) else array.cast(pa.float64())
            columns.append(flat.to_numpy(zero_copy_only=False).reshape(rows, width).T)
        return self.binned_values(np.concatenate(columns) if columns else np.zeros((0, rows)))

    def binned_values(self, values: np.ndarray) -> np.ndarray:
        """The number of thresholds below each value of (features, rows); NULL and NaN are the last bin of the feature."""
        out = np.empty(values.shape, np.uint8)
        for f, (x, cut) in enumerate(zip(values, self.thresholds, strict=True)):
            out[f] = np.where(np.isnan(x), len(cut) + 1, np.searchsorted(cut, x, side="left"))
        return out

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """Starting value and trees added up; log-odds for a classifier."""
        out = np.full(bins.shape[1], self.start)
        for tree in self.trees:
            out += tree.value[tree.leaves_of(bins, self.missing)]
        return out

    def column(self, df: DataFrame) -> Column:
        """The raw score of each row of ``df``, in Arrow batches."""

        @F.arrow_udf("double")
        def scored(*values: pa.Array) -> pa.Array:
            return pa.array(self.raw(self.binned(list(values), len(values[0]))))

        return scored(*[as_number(df, c, width) for c, width in self.features])


def as_number(df: DataFrame, column: str, width: int) -> Column:
    """A feature as a double, or a vector as an array of doubles; a NULL vector has missing values only."""
    if is_scalar(df, column):
        return F.col(column).cast("double")
    return F.coalesce(vector_to_array(F.col(column)), F.array_repeat(F.lit(None).cast("double"), width))


def is_scalar(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType | T.BooleanType)


# -- bins --------------------------------------------------------------------------------------------------


def feature_widths(df: DataFrame, features: list[str]) -> list[tuple[str, int]]:
    vectors = [c for c in features if not is_scalar(df, c)]
    sizes = df.agg(*[F.max(F.size(vector_to_array(F.col(c)))).alias(c) for c in vectors]).first() if vectors else None
    widths = [(c, int(sizes[c] or 0) if c in vectors else 1) for c in features]
    total = sum(w for _, w in widths)
    if total > MAX_FEATURES:
        raise ValueError(f"{total} features: fold rare categories first, at most {MAX_FEATURES} are binned")
    return widths


def all_values(df: DataFrame, widths: list[tuple[str, int]]) -> Column:
    """The features of a row in one array, NaN as NULL."""
    parts = [F.array(as_number(df, c, w)) if is_scalar(df, c) else as_number(df, c, w) for c, w in widths]
    joined = F.concat(*parts) if parts else F.array().cast("array<double>")
    return F.transform(joined, lambda x: F.when(~F.isnan(x), x))


def bin_thresholds(values: DataFrame, features: int) -> list[np.ndarray]:
    """Middles between the values of a feature with up to ``MAX_BINS`` of them, else its quantiles. ``values`` has an array ``xs`` per row; all rows count."""
    shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
    kinds = values.select("xs").mapInArrow(_few_values, "f int, x double").groupBy("f")
    kinds = kinds.agg(F.collect_set("x").alias("v"), F.max(F.col("x").isNull()).alias("many"))
    kinds = kinds.select("f", F.when(~F.col("many") & (F.size("v") <= MOST_COUNTED), F.col("v")).alias("v")).collect()
    found = {r["f"]: r["v"] for r in kinds if r["v"] is not None}
    unsure = sorted(f for f, v in found.items() if len(v) > SURELY_FEW)
    if unsure:
        sizes = _exploded(values, unsure).groupBy("f").agg(F.approx_count_distinct("x", 0.02).alias("n")).collect()
        for r in sizes:
            if r["n"] > MAX_BINS * 9 // 10:
                del found[r["f"]]
    few = set(found)
    many = sorted(r["f"] for r in kinds if r["f"] not in few)
    if many:
        stats = _exploded(values, many).groupBy("f").agg(F.percentile_approx("x", shares, 20_000).alias("q")).collect()
        found |= {r["f"]: r["q"] for r in stats}
    out = []
    for f in range(features):
        v = np.unique(np.array(found.get(f, []), np.float64))
        if f in few and len(v) <= MAX_BINS:
            v = v[:-1] / 2 + v[1:] / 2
        elif len(v) >= MAX_BINS:  # an estimate may be a little low
            v = v[np.linspace(0, len(v) - 1, MAX_BINS - 1).astype(int)]
        out.append(v[np.isfinite(v)])
    return out


SURELY_FEW, MOST_COUNTED = MAX_BINS * 3 // 4, MAX_BINS * 6 // 5
"""Features of about nine tenths of the bins or fewer values have a bin for each: estimated where the values are in between, clear where they are fewer or more."""


def _exploded(values: DataFrame, features: list[int]) -> DataFrame:
    """(f, x): the values of some features, one per row."""
    wanted = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.get("xs", F.lit(f)).alias("x")) for f in features]))
    return values.select(wanted.alias("v")).select("v.f", "v.x").filter("x IS NOT NULL")


def _few_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of each feature in a task's rows, or NULL where they are more than ``MOST_COUNTED``."""
    known: list[np.ndarray | None] = []
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if not len(flat):
            continue
        rows = flat.reshape(batch.num_rows, -1).T
        known = known or [np.empty(0)] * len(rows)
        for f, x in enumerate(rows):
            if known[f] is not None:
                seen = np.union1d(known[f], x[~np.isnan(x)])
                known[f] = seen if len(seen) <= MOST_COUNTED else None
    for f, seen in enumerate(known):
        x = pa.array([None], pa.float64()) if seen is None else pa.array(seen, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), f, np.int32)), x], ["f", "x"])


BLOCKS = "model int, number long, rows int, bins binary, y binary, role binary, raw binary"


def _to_blocks(model: int, booster: Booster):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        per = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(len(booster.thresholds), 1)))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # batches are smaller than a block
        rows = 0

        def out() -> pa.RecordBatch:
            bins, y, role = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            return _block_row(model, number, rows, bins, y, role, np.full(rows, booster.start))

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                some = batch.slice(lo, per - rows)
                n = some.num_rows
                y = some.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                role = some.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                xs = some.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                held.append((booster.binned_values(xs.reshape(n, -1).T if n and len(xs) else np.zeros((0, n))), y, role))
                lo, rows = lo + n, rows + n
                if rows == per:
                    yield out()
                    number, rows = number + 1, 0
                    held.clear()
        if rows:
            yield out()

    return run


BLOCKS_NAMES = ["model", "number", "rows", "bins", "y", "role", "raw"]


def _block_row(model: int, number: int, n: int, *arrays: np.ndarray | bytes) -> pa.RecordBatch:
    row = [model, number, n, *[a if isinstance(a, bytes) else a.tobytes() for a in arrays]]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], BLOCKS_NAMES)


@dataclass
class Pack:
    """Features that are summed together: each row's combination of bins among those that occur, and the bin of each feature in every one of them."""

    features: list[int]
    sizes: list[int]
    code: np.ndarray
    cells: list[np.ndarray]

    @cached_property
    def margins(self) -> np.ndarray:
        """(combinations, bins of all features): 1 where a combination has the bin."""
        return np.concatenate([(cell[:, None] == np.arange(size)).astype(np.float64) for size, cell in zip(self.sizes, self.cells, strict=True)], axis=1)


@dataclass
class Block:
    model: int
    bins: np.ndarray
    y: np.ndarray
    role: np.ndarray
    raw: np.ndarray
    codes: list[np.ndarray] | None = None
    """Each row's combination of bins, for each set of features that are summed together; None: not worked out yet."""
    packs: list[Pack] | None = None
    """The same over the combinations that occur, where all rows of a model are at hand."""
    derived: tuple[np.ndarray, np.ndarray | None] | None = None
    """Derivatives of the loss of all rows, where they are kept for the levels of a round."""


def _blocks(batches: Iterator[pa.RecordBatch], since: dict[int, list[Tree]], missing: dict[int, np.ndarray]) -> Iterator[Block]:
    """The blocks with their scores, the trees since they were stored added."""
    for batch in batches:
        for i in range(batch.num_rows):
            model, _, n, bins, y, role, raw = (batch.column(j)[i] for j in range(7))
            model, n = model.as_py(), n.as_py()
            bins = np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, n)
            raw = np.frombuffer(raw.as_buffer(), np.float64)
            for tree in since.get(model, ()):
                raw = raw + tree.value[tree.leaves_of(bins, missing[model])]
            yield Block(model, bins, np.frombuffer(y.as_buffer(), np.float64), np.frombuffer(role.as_buffer(), np.uint8), raw)


def _stored_again(since, missing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                raw = next(_blocks(iter([one]), since, missing)).raw
                yield pa.RecordBatch.from_arrays([*one.columns[:6], pa.array([raw.tobytes()], pa.binary())], BLOCKS_NAMES)

    return run


# -- losses ------------------------------------------------------------------------------------------------


def gradients(kind: str, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """First and second derivative of the loss; None stands for ones."""
    if kind == "classifier":
        p = 1 / (1 + np.exp(-raw))
        return p - y, p * (1 - p)
    return raw - y, None


def losses(kind: str, y: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if kind == "classifier":
        return np.logaddexp(0, raw) - y * raw
    return (y - raw) ** 2 / 2


def start_of(kind: str, mean: float | None) -> float:
    if mean is None:
        return 0.0
    if kind == "classifier":
        p = min(max(mean, 1e-15), 1 - 1e-15)
        return float(np.log(p / (1 - p)))
    return float(mean)


# -- sums and splits -----------------------------------------------------------------------------------------


@dataclass
class Shape:
    """How the sums of a model lie in one array: each feature's bins, the missing one last, one feature after the other."""

    sizes: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @property
    def total(self) -> int:
        return int(self.sizes.sum())


def bundles(shape: Shape) -> list[list[int]]:
    """Features that are summed together: small ones first, as many as have ``MOST_CELLS`` combinations of bins."""
    out: list[list[int]] = []
    cells = MOST_CELLS + 1
    for f in np.argsort(shape.sizes, kind="stable").tolist():
        size = int(shape.sizes[f])
        if cells * size <= MOST_CELLS:
            out[-1].append(f)
            cells *= size
        else:
            out.append([f])
            cells = size
    return out


def combined(bins: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """The combination of bins of each row, for each of ``bundles``."""
    out = []
    for first, *others in bundles(shape):
        code = bins[first]
        for f in others:
            code = code.astype(np.uint16) * np.uint16(shape.sizes[f]) + bins[f]
        out.append(code)
    return out


MOST_MARGINS = 1 << 21
"""Combinations times bins of all features that are summed together, at most."""


def packed(bins: np.ndarray, shape: Shape) -> list[Pack]:
    """Features in few packs: as many together as have ``MOST_CELLS`` combinations of bins that occur. Flags of one column, of which a row has one, take little room."""
    out: list[Pack] = []
    width = 0
    for f in np.argsort(shape.sizes, kind="stable").tolist():
        size = int(shape.sizes[f])
        if out:
            last = out[-1]
            code = last.code.astype(np.int64) * size + bins[f]
            occurs = np.bincount(code, minlength=len(last.cells[0]) * size) > 0
            kept = np.flatnonzero(occurs)
            if 0 < len(kept) <= MOST_CELLS and len(kept) * (width + size) <= MOST_MARGINS:
                number = np.cumsum(occurs) - 1
                out[-1] = Pack([*last.features, f], [*last.sizes, size], number[code].astype(np.int32), [*[c[kept // size] for c in last.cells], kept % size])
                width += size
                continue
        out.append(Pack([f], [size], bins[f].astype(np.int32), [np.arange(size)]))
        width = size
    return out


@lru_cache(256)
def _margins(sizes: tuple[int, ...]) -> np.ndarray:
    """(combinations, bins of all features): 1 where a combination has the bin."""
    cells = np.indices(sizes).reshape(len(sizes), -1)
    return np.concatenate([(cell[:, None] == np.arange(size)).astype(np.float64) for cell, size in zip(cells, sizes, strict=True)], axis=1)


def node_sums(kind: str, block: Block, slot: np.ndarray, n_slots: int, shape: Shape) -> np.ndarray:
    """(nodes, bins of all features, 3): gradient, second derivative and rows of the training rows whose node has a number in ``slot``."""
    counted = (block.role == TRAIN) & (slot >= 0)
    whole = bool(counted.all())
    rows = slice(None) if whole else np.flatnonzero(counted)
    slot = slot[rows]
    if block.derived is None:
        g, h = gradients(kind, block.y[rows], block.raw[rows])
    else:
        g, h = (x if x is None else x[rows] for x in block.derived)
    sums = np.zeros((n_slots, shape.total, 3))
    offsets, sizes = shape.offsets.tolist(), shape.sizes.tolist()
    if block.packs is not None:
        groups = [(p.features, p.code, len(p.cells[0]), lambda p=p: p.margins) for p in block.packs]
    else:
        groups = []
        for features, code in zip(bundles(shape), combined(block.bins, shape) if block.codes is None else block.codes, strict=True):
            of = tuple(sizes[f] for f in features)
            groups.append((features, code, int(np.prod(of)), partial(_margins, of)))
    for features, code, cells, margins in groups:
        kinds = tuple(sizes[f] for f in features)
        at = slot * cells + (code if whole else code[rows])
        counts = np.bincount(at, minlength=n_slots * cells)
        parts = [np.bincount(at, g, n_slots * cells), counts if h is None else np.bincount(at, h, n_slots * cells), counts]
        for k, part in enumerate(parts):
            part = part.reshape(n_slots, cells)
            if len(features) > 1:
                part = part.astype(np.float64) @ margins()
            lo = 0
            for f, size in zip(features, kinds, strict=True):
                sums[:, offsets[f] : offsets[f] + size, k] = part[:, lo : lo + size]
                lo += size
    return sums


SUMS = "model int, node int, sums binary"


def _level(kind: str, missing, growing: dict[int, Tree], slots: dict[int, np.ndarray], shapes: dict[int, Shape], want_loss: bool):
    """Sums of gradient, second derivative and rows per bin of the nodes that ``slots`` numbers; node -1 has the held-out rows' loss and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        held_out = {m: np.zeros(2) for m in growing}
        for block in _blocks(batches, {}, missing):
            m = block.model
            if m not in growing:
                continue
            if want_loss:
                at = block.role == VALID
                held_out[m] += [losses(kind, block.y[at], block.raw[at]).sum(), at.sum()]
            part = node_sums(kind, block, slots[m][growing[m].leaves_of(block.bins, missing[m])], int(slots[m].max()) + 1, shapes[m])
            sums[m] = sums[m] + part if m in sums else part
        rows = [(m, node, s.tobytes()) for m, nodes in sums.items() for node, s in enumerate(nodes)]
        if want_loss:
            rows += [(m, -1, s.tobytes()) for m, s in held_out.items()]
        for lo in range(0, len(rows), 64):
            part = rows[lo : lo + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())],
                ["model", "node", "sums"],
            )

    return run


@dataclass
class Split:
    """The best split of a node, or ``gain`` 0; sums are (gradient, second derivative, rows)."""

    gain: float
    feature: int
    bin: int
    missing_left: bool
    whole: tuple[float, float, float]
    left: tuple[float, float, float]


def best_split(sums: np.ndarray, shape: Shape, settings: Settings) -> Split:
    """``sums`` is (bins of all features, 3). Of equal gains the first feature, then the lowest bin, then missing values to the right."""
    first = sums[: int(shape.sizes[0])] if len(shape.sizes) else np.zeros((1, 3))
    whole = first.sum(0)
    none = Split(0.0, -1, -1, False, tuple(whole.tolist()), (0.0, 0.0, 0.0))
    if whole[2] < 2 * settings.least_rows or not len(shape.sizes):
        return none
    best = none
    width = 0
    for most in WIDTHS:
        features = np.flatnonzero((shape.sizes > width + 1) & (shape.sizes <= most + 1))
        width = most
        if len(features):
            found = _best_of(features, sums, shape, settings, whole, none)
            if (-found.gain, found.feature) < (-best.gain, best.feature):
                best = found
    return best


WIDTHS = (3, 15, 63, MAX_BINS)
"""Features of about as many bins are searched together: a flag takes no more room than it has bins."""


def _best_of(features: np.ndarray, sums: np.ndarray, shape: Shape, settings: Settings, whole: np.ndarray, none: Split) -> Split:
    sizes, offsets = shape.sizes[features], shape.offsets[features]
    at = np.arange(int(sizes.max()) - 1)
    regular = at < (sizes - 1)[:, None]
    grid = np.where(regular[..., None], sums[np.minimum(offsets[:, None] + at, len(sums) - 1)], 0.0)
    left = np.cumsum(grid, axis=1)  # (features, bins, 3): all up to and with the bin
    lost = sums[offsets + sizes - 1]
    left = np.stack([left, left + lost[:, None]], axis=2)  # missing values to the right, to the left
    right = whole - left

    def weight(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + settings.l2, 1e-300)

    ok = (left[..., 2] >= settings.least_rows) & (right[..., 2] >= settings.least_rows)
    ok &= (left[..., 1] >= settings.least_hessian) & (right[..., 1] >= settings.least_hessian) & regular[..., None]
    ok[..., 1] &= (lost[:, 2] > 0)[:, None]
    gain = np.where(ok, weight(left) + weight(right) - weight(whole), 0.0)
    best = int(np.argmax(gain))
    f, b, side = np.unravel_index(best, gain.shape)
    if gain[f, b, side] <= 1e-10:
        return none
    low, high = left[f, b, side], right[f, b, side]
    missing_left = bool(side) if lost[f, 2] > 0 else bool(low[2] > high[2])
    return Split(float(gain[f, b, side]), int(features[f]), int(b), missing_left, tuple(whole.tolist()), tuple(low.tolist()))


SPLITS = "model int, node int, gain double, feature int, bin int, missing_left boolean, whole array<double>, side array<double>"


def _chosen(shapes: dict[int, Shape], settings: Settings):
    """Adds up the sums of equal (model, node), which lie together, and chooses each node's split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for m, node, sums in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = m.as_py(), node.as_py()
                part = np.frombuffer(sums.as_buffer(), np.float64)
                total[key] = total[key] + part if key in total else part
        for (m, node), s in _as_splits(total, shapes, settings).items():
            row = [m, node, s.gain, s.feature, s.bin, s.missing_left, list(s.whole), list(s.left)]
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], SPLIT_SCHEMA)

    return run


NAMES = ["model", "node", "gain", "feature", "bin", "missing_left", "whole", "side"]
SPLIT_SCHEMA = pa.schema(
    list(zip(NAMES, [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.list_(pa.float64())] * 2], strict=True))
)


# -- growing -------------------------------------------------------------------------------------------------


@dataclass
class Training:
    """One model's rows: feature columns, the label, and optionally a column telling which rows only test it."""

    df: DataFrame
    features: list[str]
    label: str
    test: str | None = None


class _Growth:
    """Nodes of one tree while it grows, level by level, as if every split were taken."""

    def __init__(self):
        self.splits: list[Split | None] = [None]
        self.children: list[tuple[int, int]] = [(-1, -1)]
        self.sums: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)]
        self.frontier = [0]

    def tree(self) -> Tree:
        """Every split found so far."""
        return self._built(set(range(len(self.splits))), lambda s: 0.0)

    def take(self, found: dict[int, Split]) -> None:
        """Splits of the frontier's nodes, by their number in it."""
        nodes, self.frontier = self.frontier, []
        for i, node in enumerate(nodes):
            split = found[i]
            self.splits[node], self.sums[node] = split, split.whole
            if split.gain > 0:
                right = tuple(w - x for w, x in zip(split.whole, split.left, strict=True))
                self.children[node] = (len(self.splits), len(self.splits) + 1)
                self.frontier += self.children[node]
                for s in (split.left, right):
                    self.splits.append(None)
                    self.children.append((-1, -1))
                    self.sums.append(s)

    def finished(self, settings: Settings) -> Tree:
        """The splits of largest gain first, until there are as many leaves as allowed."""
        taken: set[int] = set()
        heap = [(-self.splits[0].gain, 0)] if self.splits[0] is not None and self.splits[0].gain > 0 else []
        while heap and len(taken) + 1 < settings.leaves:
            _, node = heapq.heappop(heap)
            taken.add(node)
            for child in self.children[node]:
                s = self.splits[child]
                if s is not None and s.gain > 0:
                    heapq.heappush(heap, (-s.gain, child))
        return self._built(taken, lambda s: -settings.rate * s[0] / max(s[1] + settings.l2, 1e-300))

    def _built(self, taken: set[int], value) -> Tree:
        inner = [i in taken and self.children[i][0] >= 0 for i in range(len(self.splits))]
        pick = [(s, ok) for s, ok in zip(self.splits, inner, strict=True)]
        return Tree(
            np.array([s.feature if ok else 0 for s, ok in pick], np.int64), np.array([s.bin if ok else 0 for s, ok in pick], np.int64),
            np.array([s.missing_left if ok else False for s, ok in pick], bool),
            np.array([c[0] if ok else -1 for c, ok in zip(self.children, inner, strict=True)], np.int64),
            np.array([c[1] if ok else -1 for c, ok in zip(self.children, inner, strict=True)], np.int64),
            np.array([0.0 if ok else value(s) for s, ok in zip(self.sums, inner, strict=True)], np.float64),
        )


def _prepared(training: Training, settings: Settings, model: int) -> tuple[Booster, DataFrame]:
    """The booster before its first tree, and the blocks of its rows."""
    df = training.df
    y = F.col(training.label).cast("double")
    testing = F.coalesce(F.col(training.test).cast("boolean"), F.lit(False)) if training.test else F.lit(False)
    df = df.withColumn("_y", F.when(~F.isnan(y), y)).withColumn("_testing", testing)
    df = df.filter("_testing OR _y IS NOT NULL")
    widths = feature_widths(df, training.features)
    # what the steps before make of a row is worked out once
    table = store(df.select("_y", "_testing", all_values(df, widths).alias("xs")), "values")
    seen = table.filter("NOT _testing")
    rows, mean = seen.agg(F.count(F.lit(1)), F.avg("_y")).first()
    booster = Booster(widths, bin_thresholds(seen, sum(w for _, w in widths)), settings.kind, start_of(settings.kind, mean))
    early = rows >= AUTO_ROWS if settings.early_stopping is None else settings.early_stopping
    held = F.pmod(F.xxhash64("_y", "xs"), F.lit(10)) == 0 if early else F.lit(False)
    role = F.when(F.col("_testing"), TEST).when(held, VALID).otherwise(TRAIN)
    return booster, table.select("_y", role.alias("_role"), "xs").mapInArrow(_to_blocks(model, booster), BLOCKS)


Splits = dict[tuple[int, int], Split]


def _as_splits(total: dict[tuple[int, int], np.ndarray], shapes: dict[int, Shape], settings: Settings) -> Splits:
    """Node -1 stands for the held-out rows: their loss and number."""
    return {
        (m, node): best_split(s.reshape(-1, 3), shapes[m], settings) if node >= 0 else Split(0.0, -1, -1, False, (*s.tolist(), 0.0), (0.0, 0.0, 0.0))
        for (m, node), s in total.items()
    }


def _grow(
    boosters: dict[int, Booster], settings: Settings, found: Callable[[dict[int, Tree], dict[int, np.ndarray], int], Splits], after: Callable[[dict[int, Tree]], None]
) -> None:
    """Rounds of all models. ``found`` gives the splits of the open nodes of a level, ``after`` hears of a round's trees."""
    active = set(boosters)
    history: dict[int, list[float]] = {m: [] for m in boosters}
    for _ in range(settings.iterations):
        growths = {m: _Growth() for m in sorted(active)}
        for level in range(settings.depth):
            open_ = {m: g for m, g in growths.items() if g.frontier}
            if not open_:
                break
            slots = {}
            for m, g in open_.items():
                slots[m] = np.full(len(g.splits), -1, np.int64)
                slots[m][g.frontier] = np.arange(len(g.frontier))
            splits = found({m: g.tree() for m, g in open_.items()}, slots, level)
            if level == 0:
                for m in list(open_):
                    loss = splits.get((m, -1))
                    if loss is not None and loss.whole[1] > 0:
                        history[m].append(loss.whole[0] / loss.whole[1])
                        if _stalled(history[m], settings.patience):
                            active.discard(m)
                            del growths[m], open_[m]
            for m, g in open_.items():
                empty = Split(0.0, -1, -1, False, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0))
                g.take({i: splits.get((m, i), empty) for i in range(len(g.frontier))})
        trees = {m: g.finished(settings) for m, g in growths.items()}
        for m, tree in trees.items():
            boosters[m].trees.append(tree)
        if not active:
            return
        after(trees)


def boost(
    trainings: list[Training], settings: Settings, direct_bytes: int = DIRECT_BYTES, one_task_bytes: int = ONE_TASK_BYTES, pack_bytes: int = PACK_BYTES
) -> tuple[list[Booster], DataFrame]:
    """Boosters of all trainings, and their blocks with final scores.

    NULL and NaN features are missing values; rows with a NULL label only count as test rows.
    """
    prepared = side_by_side([partial(_prepared, t, settings, m) for m, t in enumerate(trainings)])
    boosters = {m: b for m, (b, _) in enumerate(prepared)}
    blocks = prepared[0][1]
    for _, more in prepared[1:]:
        blocks = blocks.unionByName(more)
    blocks = store(blocks, "blocks")
    sizes = blocks.groupBy("model").agg(F.sum(F.length("bins") + 17 * F.col("rows")).alias("size")).collect()
    if max((r["size"] for r in sizes), default=0) <= one_task_bytes:
        final = _boosted_in_tasks(blocks, boosters, settings, pack_bytes)
    else:
        final = _boosted_by_jobs(blocks, boosters, settings, sum(r["size"] for r in sizes), direct_bytes)
    return [boosters[m] for m in range(len(trainings))], final


def _together(model: int, parts: list[Block]) -> tuple[Block, int]:
    """One block of all parts, the training rows first, and how many those are."""
    rows = sum(len(b.y) for b in parts)
    whole = Block(model, np.empty((len(parts[0].bins), rows), np.uint8), np.empty(rows), np.empty(rows, np.uint8), np.empty(rows))
    done = 0
    for train in (True, False):
        for b in parts:
            at = np.flatnonzero((b.role == TRAIN) == train)
            some = slice(done, done + len(at))
            whole.bins[:, some], whole.y[some], whole.role[some], whole.raw[some] = b.bins[:, at], b.y[at], b.role[at], b.raw[at]
            done += len(at)
    return whole, int((whole.role == TRAIN).sum())


def _boosted_in_tasks(blocks: DataFrame, boosters: dict[int, Booster], settings: Settings, pack_bytes: int) -> DataFrame:
    """Every model in a task of its own, which holds its blocks."""
    bare = dict(boosters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Block]] = {}
        for block in _blocks(batches, {}, {}):
            held.setdefault(block.model, []).append(block)
        for m in list(held):
            booster = bare[m]
            missing, shape = booster.missing, Shape(booster.missing + 1)
            whole, n_train = _together(m, held.pop(m))
            valid = whole.role == VALID
            train = slice(0, n_train)
            seen = Block(m, whole.bins[:, train], whole.y[train], whole.role[train], whole.raw[train])
            if whole.bins.nbytes > pack_bytes:
                seen.packs = packed(seen.bins, shape)
            else:
                seen.codes = combined(seen.bins, shape)
            node = np.zeros(len(seen.y), np.int64)

            def found(growing, slots, level, m=m, whole=whole, valid=valid, train=train, seen=seen, missing=missing, shape=shape):
                nonlocal node
                node = growing[m].step(seen.bins, missing, node) if level else np.zeros(len(seen.y), np.int64)
                if not level:
                    seen.derived = gradients(settings.kind, seen.y, whole.raw[train])
                sums = node_sums(settings.kind, seen, slots[m][node], int(slots[m].max()) + 1, shape)
                total = {(m, i): s for i, s in enumerate(sums)}
                if level == 0:
                    total[m, -1] = np.array([losses(settings.kind, whole.y[valid], whole.raw[valid]).sum(), valid.sum()])
                return _as_splits(total, {m: shape}, settings)

            def after(trees, m=m, whole=whole, missing=missing):
                whole.raw = whole.raw + trees[m].value[trees[m].leaves_of(whole.bins, missing)]

            _grow({m: booster}, settings, found, after)
            yield _block_row(m, -1, -1, pickle.dumps(booster.trees), b"", b"", b"")
            per = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(len(whole.bins), 1)))
            for number, lo in enumerate(range(0, len(whole.y), per)):
                some = slice(lo, lo + per)
                yield _block_row(m, number, len(whole.y[some]), whole.bins[:, some], whole.y[some], whole.role[some], whole.raw[some])

    dealt = blocks.repartitionByRange(len(boosters), "model").sortWithinPartitions("model", "number")
    trained = store(dealt.mapInArrow(run, BLOCKS), "boosted")
    for r in trained.filter("rows < 0").select("model", "bins").collect():
        boosters[r["model"]].trees = pickle.loads(r["bins"])
    return trained.filter("rows >= 0")


def _boosted_by_jobs(blocks: DataFrame, boosters: dict[int, Booster], settings: Settings, size: int, direct_bytes: int) -> DataFrame:
    """A job per level of all models' trees."""
    tasks = max(1, min(blocks.rdd.getNumPartitions(), -(-size // BLOCK_BYTES)))
    blocks = blocks.coalesce(tasks).persist()
    missing = {m: b.missing for m, b in boosters.items()}
    shapes = {m: Shape(b.missing + 1) for m, b in boosters.items()}
    stale: list[DataFrame] = []
    rounds = 0

    def found(growing: dict[int, Tree], slots: dict[int, np.ndarray], level: int) -> Splits:
        splits = split_by_job(growing, slots, level)
        while stale:  # the job has kept the scores that came after them
            stale.pop().unpersist()
        return splits

    def split_by_job(growing: dict[int, Tree], slots: dict[int, np.ndarray], level: int) -> Splits:
        job = blocks.mapInArrow(_level(settings.kind, missing, growing, slots, shapes, level == 0), SUMS)
        cells = sum(24 * (int(slots[m].max()) + 1) * shapes[m].total for m in growing)
        if tasks * cells > direct_bytes:
            job = job.repartition("model", "node").mapInArrow(_chosen(shapes, settings), SPLITS)
            return {
                (r["model"], r["node"]): Split(r["gain"], r["feature"], r["bin"], r["missing_left"], tuple(r["whole"]), tuple(r["side"]))
                for r in job.collect()
            }
        total: dict[tuple[int, int], np.ndarray] = {}
        for r in job.collect():
            key, part = (r["model"], r["node"]), np.frombuffer(r["sums"], np.float64)
            total[key] = total[key] + part if key in total else part
        return _as_splits(total, shapes, settings)

    def after(trees: dict[int, Tree]) -> None:
        nonlocal blocks, rounds
        rounds += 1
        scored = blocks.mapInArrow(_stored_again({m: [tree] for m, tree in trees.items()}, missing), BLOCKS)
        if rounds % STORE_EVERY == 0:
            scored = store(scored, "blocks").coalesce(tasks)
        stale.append(blocks)
        blocks = scored.persist()

    _grow(boosters, settings, found, after)
    final = store(blocks, "blocks")
    for old in (*stale, blocks):
        old.unpersist()
    return final


def _stalled(history: list[float], patience: int, least: float = 1e-7) -> bool:
    """None of the last rounds was better than the one before them."""
    if len(history) <= patience:
        return False
    before = history[-patience - 1] - least
    return not any(x < before for x in history[-patience:])


TESTED = "model int, y double, raw double"


def test_scores(blocks: DataFrame) -> DataFrame:
    """(model, y, raw) of the test rows of each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, {}, {}):
            at = (block.role == TEST) & ~np.isnan(block.y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(at.sum()), block.model, np.int32)), pa.array(block.y[at]), pa.array(block.raw[at])], ["model", "y", "raw"]
            )

    return blocks.mapInArrow(run, TESTED)
