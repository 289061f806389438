"""Column level helpers."""
