"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage.  Each module documents the
result for null, empty, very long, repeated and tied rows.
"""
