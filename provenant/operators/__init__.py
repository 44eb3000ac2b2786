"""Relational operators on graph and log tables."""
