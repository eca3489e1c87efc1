"""Column expressions of the assertion engine."""
