"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` of :mod:`textloom.llm.registry` feed ``__spark_entry__``.
"""
