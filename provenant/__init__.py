"""Execution-provenance analytics on Spark: log call sites, their graph, and the logs they emit."""
