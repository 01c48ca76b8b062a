"""Column-level helpers: scalar expressions and special functions."""
