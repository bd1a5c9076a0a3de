"""Transformers: ``fit`` reads the training rows once per statistic, ``transform`` adds column expressions.

A transformer never sees hidden columns; the rows it transforms keep them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from rowtrail.functions import ids
from rowtrail.operators.tracked import Tracked


class Transformer(Protocol):
    columns: list[str]

    def fit(self, t: Tracked) -> "Transformer": ...

    def transform(self, t: Tracked) -> Tracked: ...

    def outputs(self) -> list[str]: ...


class ColumnwiseTransformer:
    """Base of transformers that replace their columns in place."""

    def __init__(self, columns: list[str]):
        hidden = [c for c in columns if ids.is_hidden(c)]
        if hidden:
            raise ValueError(f"lineage columns are not features: {hidden}")
        self.columns = list(columns)

    def outputs(self) -> list[str]:
        return list(self.columns)


@dataclass
class Chain:
    """Steps over the same columns, each fitted on the output of the one before."""

    steps: list[Transformer]

    @property
    def columns(self) -> list[str]:
        return self.steps[0].columns

    def fit(self, t: Tracked) -> "Chain":
        for i, step in enumerate(self.steps):
            step.fit(t)
            if i + 1 < len(self.steps):
                t = step.transform(t)
        return self

    def transform(self, t: Tracked) -> Tracked:
        for step in self.steps:
            t = step.transform(t)
        return t

    def outputs(self) -> list[str]:
        return self.steps[-1].outputs()


@dataclass
class Branches:
    """Different steps for different columns. ``keep`` are columns that stay beside the outputs;
    ``remainder="passthrough"`` keeps every other data column as a feature too."""

    branches: list[Transformer]
    keep: tuple[str, ...] = ()
    remainder: str = "drop"
    _rest: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for b in self.branches for c in b.columns]

    def fit(self, t: Tracked) -> "Branches":
        used = {*self.columns, *self.keep}
        self._rest = tuple(c for c in t.columns if c not in used) if self.remainder == "passthrough" else ()
        for branch in self.branches:
            branch.fit(t)
        return self

    def transform(self, t: Tracked) -> Tracked:
        for branch in self.branches:
            t = branch.transform(t)
        return t.select(*self.keep, *self.outputs())

    def outputs(self) -> list[str]:
        return [c for b in self.branches for c in b.outputs()] + list(self._rest)
