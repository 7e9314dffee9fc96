"""Relational operators on publication records."""
