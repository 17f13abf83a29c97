"""Operators for large text corpora (training-data preparation).

Nothing outside this subpackage imports it.
"""
