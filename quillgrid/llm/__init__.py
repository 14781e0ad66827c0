"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; :mod:`quillgrid.llm.entries` registers the queries.
"""
