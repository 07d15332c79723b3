"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; its queries live in
``ledgerlens.llm.queries`` and ``corpus_pipeline.py``.
"""
