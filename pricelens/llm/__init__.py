"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_*`` queries over the test tables.  Nothing outside this
subpackage imports it.
"""
