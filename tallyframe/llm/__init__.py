"""Operators for building training corpora: ten stand-alone stages on DataFrames.

Nothing outside this subpackage imports it.
"""
