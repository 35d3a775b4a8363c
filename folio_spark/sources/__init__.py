"""Readers of document files and result files."""
