"""Queries over the project's tables."""
