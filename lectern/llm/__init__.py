"""Operators for preparing training text.

Self-contained: nothing outside this folder imports it, and it may be deleted together
with ``corpus_pipeline.py`` and ``tests/llm`` without touching the rest of the library.
"""
