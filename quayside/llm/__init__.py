"""Operators for building training corpora, one module each.

Every operator takes DataFrames with caller-named id and text columns and
returns DataFrames; ``queries`` holds the thin registered queries.
"""
