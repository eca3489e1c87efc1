"""Streams over the log."""
