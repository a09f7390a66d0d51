"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the rest of the library works
without it.  Each module holds one operator with its own general interface;
``queries`` binds them to the standard tables.
"""
