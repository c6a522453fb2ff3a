"""Relational operators that Spark has no single call for."""
