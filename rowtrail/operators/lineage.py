"""Reading lineage: edges, traces, per-row sets, sizes and checks.

The base form is the *edge table*, one row per (output row, input row). It is computed top-down: starting
from the output rows, each aggregate on the way is one join between the wanted groups and the aggregate's
input, so tracing few rows reads few, and a chain of k aggregates costs k joins.
Everything else is an aggregate over edges.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrail.functions import ids
from rowtrail.operators.forward import reached_keys
from rowtrail.operators.parts import PART_ROWS, in_parts, largest_group
from rowtrail.operators.tracked import GroupNode, Tracked
from rowtrail.sources.storage import store


# A walk through more aggregates than this writes its intermediate (output, group) pairs, else the plan of
# level k would hold the plans and the broadcast tables of all levels above it, and the driver those of all levels.
STORED_DEPTH = 2


# -- edges -------------------------------------------------------------------------------------------


def edges(t: Tracked, keys: list[str] | None = None, bag: bool = False) -> DataFrame:
    """(keys…, table_id, row_id): which input rows stand behind each output row.

    ``keys`` are data columns that name the output rows; without them the column ``_out`` holds the hidden
    columns of the row. ``bag`` adds ``times``, the number of ways an input row contributes.
    """
    packed, outs = _packed_edges(t, keys, bag)
    extra = ["times"] if bag else []
    return packed.select(
        *outs, ids.table_of(F.col("_pid")).alias("table_id"), ids.row_of(F.col("_pid")).alias("row_id"), *extra
    )


@dataclass(frozen=True)
class _Start:
    """Where a walk begins: rows with their names ``outs`` and hidden columns; ``unique`` if each id comes once per name."""

    rows: DataFrame
    outs: list[str]
    scalars: list[str]
    links: dict[str, GroupNode]
    unique: bool


def _start(t: Tracked, keys: list[str] | None) -> _Start:
    outs = list(keys) if keys is not None else ["_out"]
    node = t.fresh
    if node and (keys is None or tuple(keys) == node.keys):
        # the rows are the groups themselves: their edges are a projection of the aggregate's input
        handle = f"{ids.GROUP_PREFIX}{node.number}"
        named = [F.col("_h")[k].alias(k) for k in keys or []] if keys is not None else [
            F.struct(F.col("_h").alias(handle)).alias("_out")
        ]
        return _Start(node.inputs.select(*named, *node.scalars, *node.links), outs, list(node.scalars), node.links, node.exact)
    named = list(keys) if keys is not None else [t.row_identity().alias("_out")]
    return _Start(t.df.select(*named, *t.hidden), outs, t.scalars, t.nodes, t.exact and keys is None)


def _packed_edges(t: Tracked, keys: list[str] | None, bag: bool) -> tuple[DataFrame, list[str]]:
    start = _start(t, keys)
    outs, unique = start.outs, start.unique
    found = reduce(DataFrame.unionByName, _walk(start.rows, outs, start.scalars, start.links, bag))
    if bag:
        return found.groupBy(*outs, "_pid").agg(F.sum("times").alias("times")), outs
    return (found if unique else found.distinct()), outs


def _walk(
    rows: DataFrame, outs: list[str], scalars: list[str], links: dict[str, GroupNode], bag: bool, whole: dict[int, DataFrame] | None = None
) -> list[DataFrame]:
    """Follow every path from ``rows`` down to source ids; returns frames of (outs…, _pid, times).

    The groups of the aggregates whose numbers are in ``whole`` are not opened: it takes their distinct pairs (outs…, _h).
    """
    weight = [F.lit(1).cast("long").alias("times")] if bag else []
    carried = ["times"] if bag else []
    found: list[DataFrame] = []
    waiting: dict[int, tuple[GroupNode, list[DataFrame]]] = {}

    def visit(rows: DataFrame, scalars, links, weight) -> None:
        if len(scalars) == 1:
            found.append(rows.select(*outs, F.col(scalars[0]).alias("_pid"), *weight).filter("_pid is not null"))
        elif scalars:
            present = F.array_compact(F.array(*scalars))
            found.append(rows.select(*outs, F.explode(present).alias("_pid"), *weight))
        for column, node in links.items():
            wanted = rows.select(*outs, F.col(column).alias("_h"), *weight).filter("_h is not null")
            waiting.setdefault(node.number, (node, []))[1].append(wanted)

    visit(rows, scalars, links, weight)
    depth = 0
    while waiting:
        node, wanted = waiting.pop(max(waiting))  # an aggregate reads only older aggregates
        depth += 1
        wanted = reduce(DataFrame.unionByName, wanted)
        wanted = wanted.groupBy(*outs, "_h").agg(F.sum("times").alias("times")) if bag else wanted.distinct()
        if whole is not None and node.number in whole:
            whole[node.number] = wanted
            continue
        if not node.keys:
            wanted = store(wanted, "wanted")
            if wanted.limit(2).count() > 1:
                raise ValueError(
                    "a whole-frame aggregate was joined: every row behind it would meet every output row; "
                    "ask for factored edges, or the aggregate itself for its edges"
                )
            # one row at most, just counted
            visit(node.inputs.join(F.broadcast(wanted), "_h"), node.scalars, node.links, carried)
            continue
        if depth > STORED_DEPTH:
            wanted = store(wanted, "wanted")
        visit(wanted.join(node.inputs, "_h"), node.scalars, node.links, carried)
    if not found and not whole:
        raise ValueError("the frame carries no lineage")
    return found


def factored(t: Tracked, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The edges as two frames that are never multiplied: (keys…, group, table_id, row_id) and (group, table_id, row_id).

    The first has one row per output row and direct id, or per output row and group it refers to (then ``table_id`` is NULL). The second
    has the ids behind each group. ``group`` is text made of the aggregate's number and keys. Joined on ``group`` they give ``edges``; kept
    apart they are as long as the rows and the groups' members, not their product.
    """
    direct: list[DataFrame] = []
    members: list[DataFrame] = []

    def name(node: GroupNode, handle: Column) -> Column:
        return F.concat(F.lit(f"{node.number}:"), F.to_json(handle))

    nothing = F.lit(None).cast("long")
    if t.scalars:
        present = F.array_compact(F.array(*t.scalars))
        direct.append(t.df.select(*keys, F.lit(None).cast("string").alias("group"), F.explode(present).alias("_pid")))
    for column, node in t.nodes.items():
        handle = F.col(column)
        direct.append(t.df.filter(handle.isNotNull()).select(*keys, name(node, handle).alias("group"), nothing.alias("_pid")))
        rows = node.inputs.select(name(node, F.col("_h")).alias("group"), *node.scalars, *node.links)
        members += [found.select("group", "_pid") for found in _walk(rows, ["group"], list(node.scalars), node.links, False)]
    if not members:
        members.append(t.df.sparkSession.createDataFrame([], "group string, _pid long"))

    def opened(frames: list[DataFrame], outs: list[str]) -> DataFrame:
        both = reduce(DataFrame.unionByName, frames).distinct()
        pid = F.col("_pid")
        return both.select(*outs, F.when(pid.isNotNull(), ids.table_of(pid)).alias("table_id"), ids.row_of(pid).alias("row_id"))

    return opened(direct, [*keys, "group"]), opened(members, ["group"])


def trace_back(t: Tracked, condition: Column | str, keys: list[str]) -> DataFrame:
    """Edges of the output rows that satisfy ``condition``."""
    return edges(t.filter(condition), keys)


def trace_forward(t: Tracked, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Output rows reached from ``inputs`` (table_id, row_id), found from below: no edges are computed."""
    return reached_keys(t, inputs, keys)


def compose(upper: DataFrame, lower: DataFrame, on: list[str]) -> DataFrame:
    """Chain two stored edge tables: ``upper`` (outs…, on…) over ``lower`` (on…, table_id, row_id)."""
    outs = [c for c in upper.columns if c not in on]
    return upper.join(lower, on).select(*outs, "table_id", "row_id").distinct()


def store_edges(t: Tracked, keys: list[str], bag: bool = False) -> DataFrame:
    """Write the edge table to the shared folder and read it back."""
    return store(edges(t, keys, bag), "edges")


# -- one set per row -----------------------------------------------------------------------------------


def consolidate(t: Tracked, reducer: str = "set", part_ids: int = PART_ROWS) -> DataFrame:
    """The data with ``_prov``, the sorted ids behind each row, in place of the hidden columns; one row per row.

    A frame in which more than ``part_ids`` ids may stand behind a row is refused: ``edges`` gives them as rows and ``set_parts`` as arrays
    of bounded length, in a frame of their own. ``reducer="bag"`` adds ``_times``, how often each id of ``_prov`` contributes.
    """
    if reducer not in ("set", "bag"):
        raise ValueError("reducer must be set or bag")
    data = t.columns
    if not t.nodes and reducer == "set":
        ids_here = F.array_compact(F.array(*_by_table(t)))
        if not _one_id_per_table(t):
            ids_here = F.array_sort(F.array_distinct(ids_here))
        return t.df.select(*data, ids_here.alias("_prov"))
    bag = reducer == "bag"
    if (n := largest_set(t)) > part_ids:
        raise ValueError(f"up to {n} ids behind one row, more than {part_ids}: use edges or set_parts")
    if not bag and all(node.keys for node in t.nodes.values()):
        rows, arrays = _with_group_sets(t.df, t.scalars, t.nodes)
        whole = F.array_sort(F.array_distinct(F.concat(*arrays)))
        return rows.select(*data, whole.alias("_prov"))
    found, _ = _packed_edges(t, None, bag)
    kept = F.struct("_pid", "times") if bag else F.col("_pid")
    cells = found.groupBy("_out").agg(F.array_sort(F.collect_list(kept)).alias("_ids"))
    empty = F.array().cast("array<bigint>")
    times = [F.coalesce(F.col("_ids.times"), empty).alias("_times")] if bag else []
    return (
        t.df.withColumn("_out", t.row_identity())
        .join(cells, "_out", "left")
        .select(
            *data,
            F.coalesce(F.col("_ids._pid" if bag else "_ids"), empty).alias("_prov"),
            *times,
        )
    )


def set_parts(t: Tracked, keys: list[str], part_ids: int = PART_ROWS) -> DataFrame:
    """(keys…, _part, _prov): the sorted ids behind each output row in arrays of at most ``part_ids``, parts numbered from 0.

    Apart from the data, so that a row's data is never repeated; a row without lineage has no part.
    """
    found, outs = _packed_edges(t, keys, bag=False)
    parted = in_parts(found, outs, ["_pid"], part_ids)
    return parted.groupBy(*outs, "_part").agg(F.array_sort(F.collect_list("_pid")).alias("_prov"))


def _with_group_sets(rows: DataFrame, scalars, links: dict[str, GroupNode]) -> tuple[DataFrame, list[Column]]:
    """Join the id set of each linked group to the rows; returns them and the arrays of ids of one row.

    Only for sets with a known bound: each group's ids are collected into one array.
    """
    arrays = [F.array_compact(F.array(*scalars))] if scalars else []
    for i, (column, node) in enumerate(links.items()):
        inputs, inner = _with_group_sets(node.inputs, node.scalars, node.links)
        if len(node.scalars) == 1 and not node.links:
            collected = F.collect_set(node.scalars[0])
        else:
            collected = F.array_distinct(F.flatten(F.collect_list(F.concat(*inner))))
        sets = inputs.groupBy(F.col("_h").alias(f"_h{i}")).agg(collected.alias(f"_ids{i}"))
        rows = rows.join(sets, F.col(column) == F.col(f"_h{i}"), "left").drop(f"_h{i}")
        arrays.append(F.coalesce(F.col(f"_ids{i}"), F.array().cast("array<bigint>")))
    return rows, arrays


def largest_set(t: Tracked) -> int:
    """An upper bound of the number of ids behind one row, from one count per aggregate on the way."""

    def bound(scalars, links: dict[str, GroupNode]) -> int:
        return len(scalars) + sum(_largest_group(n) * bound(n.scalars, n.links) for n in links.values())

    return bound(t.scalars, t.nodes)


def _largest_group(node: GroupNode) -> int:
    return largest_group(node.inputs, ["_h"])


def decode(consolidated: DataFrame, trail) -> DataFrame:
    """Turn the ids of ``_prov`` into ``table:row`` tokens, ordered by table number and row number."""
    ordered = F.col("_prov")
    if max(trail.names, default=0) >= ids.MAX_TABLES // 2:
        # packed ids of these tables are negative: bring them behind the others
        ordered = F.concat(F.filter(ordered, lambda p: p >= 0), F.filter(ordered, lambda p: p < 0))
    tokens = F.transform(ordered, lambda p: ids.token(p, trail.names))
    return consolidated.withColumn("_prov", tokens)


def _by_table(t: Tracked) -> list[str]:
    return sorted(t.scalars, key=ids.table_number)


def _one_id_per_table(t: Tracked) -> bool:
    """True if the id columns in table order are the sorted set: no table twice, no negative packed ids."""
    numbers = {ids.table_number(c) for c in t.scalars}
    return len(numbers) == len(t.scalars) and max(numbers, default=0) < ids.MAX_TABLES // 2


def decoded(t: Tracked, part_ids: int = PART_ROWS) -> DataFrame:
    """``consolidate`` and ``decode`` in one call."""
    if not t.nodes and _one_id_per_table(t):
        # the table of each column is known: plain expressions instead of array functions with lambdas
        names = t.trail.names
        tokens = [
            F.concat(F.lit(f"{names[ids.table_number(c)]}:"), ids.row_of(F.col(c)).cast("string")) for c in _by_table(t)
        ]
        return t.df.select(*t.columns, F.array_compact(F.array(*tokens)).alias("_prov"))
    return decode(consolidate(t, part_ids=part_ids), t.trail)


def token_edges(t: Tracked, keys: list[str]) -> DataFrame:
    """(keys…, token): the decoded lineage in long form, for groups of any size."""
    packed, outs = _packed_edges(t, keys, bag=False)
    return packed.select(*outs, ids.token(F.col("_pid"), t.trail.names).alias("token"))


# -- sizes and checks ---------------------------------------------------------------------------------


def summary(t: Tracked, keys: list[str]) -> DataFrame:
    """Per output row: number of ids, smallest, largest and the xor of all. Built without arrays.

    A group that many rows refer to is summed up once: where no other path leads to its table, its ids are counted beside those of the
    other paths, and rows are never multiplied by the members of their groups.
    """
    start = _start(t, keys)
    nodes = _nodes_below(start.links)
    tables = Counter(ids.table_number(c) for scalars in (start.scalars, *(n.scalars for n in nodes.values())) for c in scalars)
    alone = {i: n for i, n in nodes.items() if n.exact and n.keys and all(tables[ids.table_number(c)] == 1 for c in n.scalars)}
    whole: dict[int, DataFrame] = dict.fromkeys(alone)
    found = _walk(start.rows, start.outs, start.scalars, start.links, False, whole)
    parts = []
    if found:
        pairs = reduce(DataFrame.unionByName, found)
        parts.append((pairs if start.unique else pairs.distinct()).groupBy(*start.outs).agg(*summed()))
    for number, node in alone.items():
        members = node.inputs.select("_h", F.col(node.scalars[0]).alias("_pid")).filter("_pid is not null")
        if not node.numbered:  # a declared key may repeat after all
            members = members.distinct()
        parts.append(whole[number].join(members.groupBy("_h").agg(*summed()), "_h").drop("_h"))
    if len(parts) == 1 and found:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy(*start.outs).agg(
        F.sum("prov_n").alias("prov_n"), F.min("prov_min").alias("prov_min"), F.max("prov_max").alias("prov_max"), F.bit_xor("prov_xor").alias("prov_xor")
    )


def summed() -> list[Column]:
    """The columns of a summary, of different ids."""
    pid = F.col("_pid")
    return [F.count(F.lit(1)).alias("prov_n"), F.min(pid).alias("prov_min"), F.max(pid).alias("prov_max"), F.bit_xor(pid).alias("prov_xor")]


def _nodes_below(links: dict[str, GroupNode]) -> dict[int, GroupNode]:
    """All aggregates that a walk through ``links`` meets, by number."""
    found: dict[int, GroupNode] = {}
    todo = list(links.values())
    while todo:
        node = todo.pop()
        if node.number not in found:
            found[node.number] = node
            todo += node.links.values()
    return found


def with_summary(t: Tracked, keys: list[str]) -> DataFrame:
    """The data beside its lineage summary; ``keys`` must name the rows."""
    if t.nodes and not (t.fresh and tuple(keys) == t.fresh.keys):
        t = t.stored("summed")  # read once for the data and once for each hidden column
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    sizes = summary(t, keys).withColumnsRenamed(named)
    plain = t.fresh and t.fresh.null_free and tuple(keys) == t.fresh.keys
    # plain equality lets both sides keep the partitioning of their aggregates
    pairs = [F.col(k) == F.col(n) if plain else F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    match = reduce(lambda a, b: a & b, pairs)
    return t.untracked().join(sizes, match, "left").drop(*named.values()).fillna(0, ["prov_n"])


def footprint(t: Tracked, keys: list[str] | None = None) -> DataFrame:
    """Per source table: edges, largest set of one row, bytes of the packed ids."""
    packed, outs = _packed_edges(t, keys, bag=False)
    per_row = packed.groupBy(*outs, ids.table_of(F.col("_pid")).alias("table_id")).agg(F.count(F.lit(1)).alias("n"))
    return per_row.groupBy("table_id").agg(
        F.sum("n").alias("edges"), F.max("n").alias("largest"), (F.sum("n") * 8).alias("bytes")
    )


def rows_without_lineage(t: Tracked) -> DataFrame:
    """Rows in which no hidden column points anywhere (none, for a sound operator)."""
    return t.df.filter(reduce(lambda a, b: a & b, [F.col(c).isNull() for c in t.hidden]))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame missing in the other, with repeats counted; empty means the same content.

    Both frames are read and counted once, together."""
    columns = sorted(a.columns)
    both = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    more = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, "first").otherwise("second").alias("_side")
    return more.select(*columns, side, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_copy")).drop("_copy")
