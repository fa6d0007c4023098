"""Column expressions: text, document profile, structure, paths."""
