"""Continuous enrichment of log streams."""
