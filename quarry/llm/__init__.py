"""Operators of a large-scale training-data pipeline.

One module per operator; ``queries.py`` applies them to the driver tables.
Nothing outside this package (and the top-level ``corpus_pipeline.py``) imports it.
"""
