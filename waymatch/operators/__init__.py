"""Relational building blocks of a merge."""
