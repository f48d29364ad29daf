"""Operators for preparing language-model training data.

Nothing outside this package imports it; it may be deleted with ``tests/llm`` and ``corpus_pipeline.py``.
"""
