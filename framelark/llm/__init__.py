"""Operators for training-data corpora. Nothing outside this subpackage imports it, save __spark_entry__.py."""
