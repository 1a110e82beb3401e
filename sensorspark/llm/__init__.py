"""Operators of a training-data pipeline over documents, pages, vectors and conversations."""
