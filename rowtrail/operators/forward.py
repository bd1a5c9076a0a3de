"""Forward tracing, from given input rows upwards: which groups and which output rows do they reach?

The walk starts at the inputs. Each aggregate on the way, oldest first, is one step: of its input rows only those are kept that carry a
wanted id or the handle of a group reached before, and their groups are what the next step looks for. So nothing is multiplied, no edge is
computed, tables that none of the inputs belongs to are never opened, and a step writes as much as it hits. Catalyst moves the
semi-joins of a step below projections, joins and aggregates down to the scan they ask about.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtrail.functions import ids
from rowtrail.operators.tracked import GroupNode, Tracked
from rowtrail.sources.storage import store

LISTED_IDS = 1_000  # so few wanted ids of a table are written into the plan
SMALL_BYTES = 32 << 20  # wanted ids or groups counted to take no more are broadcast


class _Climb:
    """What the inputs reach, group by group; ``reached`` maps an aggregate's number to its groups (column ``_hit``), None if there are none."""

    def __init__(self, inputs: DataFrame, nodes: list[GroupNode], listed_ids: int, small_bytes: int):
        self.listed_ids, self.small_bytes = listed_ids, small_bytes
        table, row = F.col("table_id").cast("long"), F.col("row_id").cast("long")
        valid = inputs.filter(table.between(0, ids.MAX_TABLES - 1) & row.between(0, ids.MAX_ROW))
        packed = F.shiftleft(table, ids.ROW_BITS).bitwiseOR(row)
        self.wanted = store(valid.select(packed.alias("_hit")).distinct(), "wanted")
        # one row per table of the inputs
        sizes = self.wanted.groupBy(ids.table_of(F.col("_hit")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
        self.sizes = {r["t"]: r["n"] for r in sizes.collect()}
        self.reached: dict[int, DataFrame | None] = {}
        for node in sorted(nodes, key=lambda x: x.number):  # an aggregate reads only older ones
            self.reached[node.number] = self._groups(node)

    def _groups(self, node: GroupNode) -> DataFrame | None:
        found = [rows.select(F.col("_h").alias("_hit")) for rows in self.meeting(node.inputs, node.scalars, node.links)]
        if not found:
            return None
        groups = store(reduce(DataFrame.unionByName, found).distinct(), "reached")
        n, size = groups.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json("_hit")))).first()
        return self._sized(groups, 32 * n + size) if n else None

    def _sized(self, hits: DataFrame, size: int) -> DataFrame:
        return F.broadcast(hits) if size <= self.small_bytes else hits.hint("merge")

    def lookups(self, scalars, links: dict[str, GroupNode]) -> tuple[Column | None, list[tuple[str, DataFrame]]]:
        """What tells a reached row: a condition on the ids that fit into the plan, and (column, distinct hits) to join on."""
        listed, joined = [], []
        for column in scalars:
            table = ids.table_number(column)
            n = self.sizes.get(table, 0)
            own = self.wanted.filter(ids.table_of(F.col("_hit")) == table)
            if 0 < n <= self.listed_ids:
                listed.append(F.col(column).isin([r["_hit"] for r in own.collect()]))
            elif n:
                joined.append((column, self._sized(own, 40 * n)))
        joined += [(c, self.reached[node.number]) for c, node in links.items() if self.reached[node.number] is not None]
        return (reduce(lambda a, b: a | b, listed) if listed else None), joined

    def meeting(self, rows: DataFrame, scalars, links: dict[str, GroupNode]) -> list[DataFrame]:
        """The reached rows, one frame per way of reaching them; a row may stand in several."""
        condition, joined = self.lookups(scalars, links)
        found = [] if condition is None else [rows.filter(condition)]
        return found + [rows.join(hits, F.col(column) == F.col("_hit"), "left_semi") for column, hits in joined]


def _nodes_below(links: dict[str, GroupNode]) -> list[GroupNode]:
    found: dict[int, GroupNode] = {}
    waiting = list(links.values())
    while waiting:
        node = waiting.pop()
        if node.number not in found:
            found[node.number] = node
            waiting += node.links.values()
    return list(found.values())


def reached_keys(t: Tracked, inputs: DataFrame, keys: list[str], listed_ids: int = LISTED_IDS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The distinct ``keys`` of the output rows that some row of ``inputs`` (table_id, row_id) stands behind.

    NULL and repeated inputs, and ids that no table has, add nothing. If the rows are the groups of the last aggregate and ``keys`` are
    among its keys, the frame itself is not read. Up to ``listed_ids`` ids of a table stand in the plan; more, and groups, are broadcast if
    counted to be below ``small_bytes``, else joined by a shuffle.
    """
    climb = _Climb(inputs, _nodes_below(t.nodes), listed_ids, small_bytes)
    if t.fresh and set(keys) <= set(t.fresh.keys):
        groups = climb.reached[t.fresh.number]
        if groups is not None:
            return groups.select(*[F.col("_hit")[k].alias(k) for k in keys]).distinct()
        found = []
    else:
        found = [rows.select(*keys) for rows in climb.meeting(t.df, t.scalars, t.nodes)]
    return reduce(DataFrame.unionByName, found).distinct() if found else t.df.select(*keys).filter(F.lit(False))


def affected(
    t: Tracked, inputs: DataFrame, reached: bool = True, listed_ids: int = LISTED_IDS, small_bytes: int = SMALL_BYTES
) -> Tracked:
    """The output rows that some row of ``inputs`` (table_id, row_id) stands behind, whole and with their lineage; the others if ``reached`` is False.

    Rows are never repeated or merged, however many of the inputs reach them.
    """
    climb = _Climb(inputs, _nodes_below(t.nodes), listed_ids, small_bytes)
    condition, joined = climb.lookups(t.scalars, t.nodes)
    if condition is None and not joined:
        return replace(t, df=t.df.filter(F.lit(not reached)), fresh=None)
    if condition is None and len(joined) == 1:
        column, hits = joined[0]
        df = t.df.join(hits, F.col(column) == F.col("_hit"), "left_semi" if reached else "left_anti")
        return replace(t, df=df, fresh=None)
    df, flags = t.df, [] if condition is None else [F.coalesce(condition, F.lit(False))]
    for i, (column, hits) in enumerate(joined):
        # hits are distinct, so a left join keeps the rows as they are
        own = hits.withColumnRenamed("_hit", f"_hit{i}")
        df = df.join(own, F.col(column) == F.col(f"_hit{i}"), "left")
        flags.append(F.col(f"_hit{i}").isNotNull())
    hit = reduce(lambda a, b: a | b, flags)
    return replace(t, df=df.filter(hit if reached else ~hit).select(*t.df.columns), fresh=None)
