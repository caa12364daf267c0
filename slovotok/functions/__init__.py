"""Subpackage of slovotok."""
