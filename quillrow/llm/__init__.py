"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general
interface; ``queries`` holds the thin registered queries and ``oracles`` their SQL.
"""
