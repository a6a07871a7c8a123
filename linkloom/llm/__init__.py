"""Training-data operators: filtering, language id, deduplication, tokenising, sharding and mixing.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
