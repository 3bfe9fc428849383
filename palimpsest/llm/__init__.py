"""Operators for large training-data pipelines (documents, embeddings, conversations).

Nothing outside this subpackage imports it.
"""
