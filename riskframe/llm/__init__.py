"""Operators for large text corpora (training-data preparation).

One module per operator; ``queries.py`` registers the thin ``opN_<name>``
queries. Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
