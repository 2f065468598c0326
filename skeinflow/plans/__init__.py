"""Composite pipelines over evidence documents."""
