"""Training-data operators: filters, deduplication, scoring and mixing of text corpora.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` holds the
registered queries and ``queries.ORACLES`` their SQL where SQL can state them.
"""
