"""Operators of a training-data pipeline over documents and embeddings.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``queries`` applies them to the given tables.
"""
