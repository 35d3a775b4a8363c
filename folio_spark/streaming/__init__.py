"""Structured Streaming over log events and incremental work."""
