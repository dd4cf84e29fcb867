from sparkloom.operators.relational import (
    JOIN_TYPES, aggregate, join, limit, map_columns, order_by, project, rename, select, top_k,
)
from sparkloom.operators.subquery import any_compare, count_correlated, exists, in_subquery, mark_join, not_in_subquery, right_mark_join, scalar_correlated

__all__ = [
    "JOIN_TYPES", "aggregate", "any_compare", "count_correlated", "exists", "in_subquery", "join", "limit", "map_columns",
    "mark_join", "not_in_subquery", "order_by", "project", "rename", "right_mark_join", "scalar_correlated", "select", "top_k",
]
