"""Exact integer arithmetic over text and tables, as DataFrame expressions."""
