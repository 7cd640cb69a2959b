"""Lectern: prepare, search and audit large text collections with Spark."""
