"""Operators for training-data pipelines: one module per operator, the queries
and their SQL in ``registry``. Nothing else in the library imports this."""
