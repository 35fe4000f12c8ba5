"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this subpackage imports it.  Every operator reads whole tables
and whole texts; the queries over the standard tables are in ``queries``.
"""
