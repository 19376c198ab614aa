"""Training-data operators: ten dealt operators and the queries that apply them.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which counts as
part of it) imports from here.
"""
