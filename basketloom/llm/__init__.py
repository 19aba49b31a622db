"""Training-data operators: deduplication, filtering, scoring, tokenisation and layout of text corpora.

Nothing outside this subpackage imports it; the queries and their SQL are in ``queries``.
"""
