"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin queries over the shared tables are in ``queries.py``.
"""
