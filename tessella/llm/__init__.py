"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; its queries and SQL live in
``queries.py`` beside the operators.
"""
