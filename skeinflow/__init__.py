"""Spark-first analytics over evidence, contacts and training corpora."""
