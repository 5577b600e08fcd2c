"""Operators for preparing language-model training data.

Ten operators, one module each, plus the modules they share (``shared``,
``tokens``, ``words``).  ``entries`` registers the contract queries.  Nothing
outside this subpackage imports it.
"""
