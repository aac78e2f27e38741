"""Operators for preparing training data: splitting, clustering, vectors, percentiles, tokens, leaks, truncation.

Nothing outside this package imports it.
"""
