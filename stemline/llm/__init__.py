"""Training-data operators: tokenising, deduplication, scoring, extraction, mixing.

Nothing outside this subpackage imports it.
"""
