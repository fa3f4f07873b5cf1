"""Column-level helpers and distributed ranking."""
