"""Relational operators over the core tables. Each is a composition of DataFrame operations."""
