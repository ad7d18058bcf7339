"""Operators of a training-data pipeline over text corpora.

Nothing else in ``emberlog`` imports this subpackage. Each operator module has
a general interface of its own; :mod:`emberlog.llm.queries` derives the fixed
result columns of the registered queries from them.
"""
