"""Operators for building language-model training corpora.

Self-contained: nothing outside this folder imports it.  Each module holds one
operator with its own general interface; ``queries`` binds them to the test
tables.
"""
