"""Training-data operators: chat formatting, deduplication, filtering, tokens.

Nothing outside this subpackage imports it.
"""
