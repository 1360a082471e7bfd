"""Operators for training-data pipelines: text, tokens, vectors and conversations.

Nothing outside this subpackage imports it.  ``factweave.llm.queries`` registers
one query per operator; ``corpus_pipeline.py`` at the repository top chains five
of them.
"""
