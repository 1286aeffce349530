"""Column expressions: identity, paths, text tests."""
