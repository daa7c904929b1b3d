"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. `queries.py` holds the
registered queries, `corpus_pipeline.py` at the repository top the pipeline.
"""
