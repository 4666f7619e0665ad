"""Operators for preparing language-model training corpora with Spark.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin registered queries over them.
"""
