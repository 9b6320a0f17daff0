"""Column expressions: text functions and statistics."""
