"""Operators of a training-data pipeline over a corpus of documents.

One module per operator; `queries` registers one query `opN_<name>` for each. Nothing
outside this package (but the guarded hook of `__spark_entry__.py`) imports it.
"""
