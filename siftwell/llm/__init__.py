"""Operators for preparing large text corpora for model training.

Each module holds one operator with its own general interface.  ``queries``
registers the thin contract queries built on them.
"""
