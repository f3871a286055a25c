"""Corpus-preparation operators for language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one operator with its
general interface and, at its end, the thin ``opN_<name>`` query over the synthetic tables.
"""
