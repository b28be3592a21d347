"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns a DataFrame; ``queries.py`` applies each one to its whole table.
"""
