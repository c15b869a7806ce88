"""Column functions over source text and keys."""
