"""Operators for preparing large text collections for language-model training.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface;
``queries`` binds them to the test tables.
"""
