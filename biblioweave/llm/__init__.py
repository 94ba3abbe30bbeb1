"""Operators of a training-data pipeline over documents and web pages.

Nothing outside this subpackage imports it, except the query list and the
pipeline at the top of the repository.
"""
