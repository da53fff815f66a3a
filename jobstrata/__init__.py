"""Posting analytics as PySpark table-in/table-out operators."""
