"""Structured Streaming forms of the log, the session and the batch operators."""
