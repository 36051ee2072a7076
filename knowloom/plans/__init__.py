"""Pipelines made of several operators: ingest, ask, change events."""
