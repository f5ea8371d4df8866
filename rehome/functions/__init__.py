"""Column functions and small per-document helpers."""
