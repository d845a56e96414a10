"""Training-data operators: scoring, filtering, deduplication, mixing and tokenizing of text corpora.

Nothing outside this subpackage imports it; it may use the rest of the library.
"""
