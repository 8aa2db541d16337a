"""Operators for preparing training text, each a Spark job; nothing outside this subpackage imports it."""
