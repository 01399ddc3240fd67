"""Training-data operators: extraction, tokens, search, privacy, filters and deduplication.

Nothing outside this folder imports it.
"""
