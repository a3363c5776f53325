"""Operators of a large-scale training-data pipeline.

Nothing else in ``veilspan`` imports this subpackage.
"""
