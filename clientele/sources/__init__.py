"""Scans and sinks, and the canonical views over the input tables."""
