"""Training-data operators: mixing, sharding, deduplication, quality, toxicity, counting.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
