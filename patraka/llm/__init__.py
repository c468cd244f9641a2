"""Operators for preparing training data.

Nothing else in the library imports this package; ``patraka.llm.queries`` binds the
operators to the provided tables.
"""
