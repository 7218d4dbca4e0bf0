"""Column expressions: text, quality, markers, numbers."""
