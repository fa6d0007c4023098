"""Operators for building language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`tessera.llm.queries` binds them
to the registered queries.
"""
