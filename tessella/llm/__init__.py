"""Operators for training data: overlap, grouping, sampling, dedup, packing, leaks, sentences.

Nothing outside this subpackage imports it.
"""
