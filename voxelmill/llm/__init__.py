"""Operators for preparing training text.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
