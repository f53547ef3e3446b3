"""Corpus operators for training data: extraction, dedup, scoring, mixing, encoding.

Nothing outside this subpackage imports it.
"""
