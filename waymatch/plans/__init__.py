"""Whole merges."""
