"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries`` registers one query
per operator; every operator module documents its own interface and what it
returns for nulls, empty texts, ties, repeated rows and empty tables.
"""
