"""Operators for large training-data corpora: deduplication, filtering, tokens, packing, shards.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
