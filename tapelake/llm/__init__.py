"""Operators for building text corpora: duplicates, archives, filters, tokens, search and personal data.

Nothing outside this folder imports it; its queries are in `queries.py`.
"""
