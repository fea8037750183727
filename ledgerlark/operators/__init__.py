"""Relational operators over canonical tables."""
