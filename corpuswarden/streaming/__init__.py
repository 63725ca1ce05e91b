"""Structured Streaming forms of the timed and repeated checks."""
