"""Whole queries and reports composed from the operators."""
