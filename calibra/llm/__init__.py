"""Operators for large-scale training-data pipelines.

One module per operator; ``catalog`` registers their queries and SQL.
Nothing outside this subpackage imports it except ``__spark_entry__``.
"""
