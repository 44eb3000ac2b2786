"""Graphs as files, documents and definitions for log stores."""
