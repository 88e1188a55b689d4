"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``catalog`` registers one query for each of them and the pipeline.
"""
