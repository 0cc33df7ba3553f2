"""Operators for preparing text corpora for language-model training.

Nothing outside this subpackage imports it.
"""
