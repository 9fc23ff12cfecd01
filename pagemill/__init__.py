"""Data work around document pages, written as Spark DataFrame operators."""
