"""Operators for preparing language-model training data.

Ten operators over the ``documents``, ``pages``, ``benchmark``, ``labels``,
``embeddings`` and ``conversations`` tables, and the registered queries that
apply them to whole tables (``queries.py``). Nothing else in the library
imports this subpackage.
"""
