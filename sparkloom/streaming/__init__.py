"""No streaming operators: the engine's scope is finite SELECT queries.

Every operator here takes and returns DataFrames without actions, so the
row-wise ones also run on streaming DataFrames unchanged.
"""
