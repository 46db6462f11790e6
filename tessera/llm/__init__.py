"""Operators for large training corpora. Nothing else in the library imports this
subpackage; :mod:`tessera.llm.queries` lists their registered queries."""
