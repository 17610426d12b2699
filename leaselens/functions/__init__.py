"""Scalar functions over columns: text, geometry, similarity."""
