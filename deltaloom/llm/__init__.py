"""Training-data pipeline operators.

Nothing outside this subpackage (and the repository-level ``corpus_pipeline``)
imports it; it may be removed without touching the rest of the library.
"""
