"""Relational operators over corpus, retrieval and telemetry tables."""
