"""Structured Streaming forms of the change-event operators."""
