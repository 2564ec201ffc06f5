"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may be deleted and the
rest keeps working.  Every operator takes and returns DataFrames; ``queries``
holds the thin registered queries.
"""
