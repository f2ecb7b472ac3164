"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  ``registry`` holds the queries and SQL that
``__spark_entry__`` adds when the subpackage is present.
"""
