"""Operators: ``DataFrame -> DataFrame``, the same for tables and for streams."""
