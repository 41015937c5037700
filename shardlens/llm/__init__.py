"""Operators of a training-data pipeline: mixing, page text, BPE, toxicity, deduplication, sharding, search, collocations, quality.

Nothing outside this package imports it; its queries are listed in :mod:`shardlens.llm.catalog`.
"""
