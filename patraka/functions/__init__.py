"""Column expressions: text, numbers, code switching, error rates."""
