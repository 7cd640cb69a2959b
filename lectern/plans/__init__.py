"""Registered queries: operators applied to whole tables."""
