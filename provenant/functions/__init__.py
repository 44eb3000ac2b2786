"""Column functions and their constants."""
