"""Relational operators that SQL dialects have and DataFrames lack."""

from tidelake.operators.joins import asof_join, lateral_top_k, not_in, pair_counts, range_join
from tidelake.operators.select import asc, desc, distinct_on, limit_by_scalar, top_k_per_group, top_n, with_ties

__all__ = ["asc", "asof_join", "desc", "distinct_on", "lateral_top_k", "limit_by_scalar", "not_in", "pair_counts", "range_join", "top_k_per_group", "top_n", "with_ties"]
