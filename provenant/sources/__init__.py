"""Source trees, saved graphs and repositories as tables."""
