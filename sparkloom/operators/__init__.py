"""Operators from tables to small flat tables, all lazy and declarative."""
