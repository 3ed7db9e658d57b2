"""Training-data operators: deduplication, filtering, scoring and tokenization.

Nothing outside this subpackage imports it.
"""
