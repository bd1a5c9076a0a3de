"""Row-level data lineage for PySpark DataFrames."""

from rowtrail.operators.aggregate import aggregate, frequencies
from rowtrail.operators.joins import join
from rowtrail.operators.tracked import Tracked, register_operator
from rowtrail.sources.trail import Trail

__all__ = ["Tracked", "Trail", "aggregate", "frequencies", "join", "register_operator"]
