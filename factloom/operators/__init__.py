"""Operators of the assertion engine, each a DataFrame plan."""
