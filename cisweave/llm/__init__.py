"""Operators for large text and training-data pipelines. Nothing outside this subpackage imports it."""
