"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it is present.  One module per operator, each with its
own general interface; ``queries.py`` holds the thin registered queries.
"""
