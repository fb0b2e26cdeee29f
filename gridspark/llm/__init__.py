"""Operators for building text corpora: filtering, deduplication, mixing, tokenisation and output.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries.
"""
