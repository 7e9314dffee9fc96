"""Operators for large text corpora: quality, dedup, tokens, mixing, search, archives.

Every operator takes and returns DataFrames.  ``queries.py`` derives the registered
``opN_*`` queries from them; nothing outside this subpackage imports it.
"""
