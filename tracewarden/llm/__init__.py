"""Training-data operators: deduplication, filtering, tokenising and packing of text corpora.

Nothing outside this subpackage imports it. Each module holds one operator with its own
general interface; ``queries`` holds the thin queries that apply them to whole tables.
"""
