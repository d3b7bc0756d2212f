"""Operators for large training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator as
functions on DataFrames; :mod:`barspark.llm.queries` applies them to the tables.
"""
