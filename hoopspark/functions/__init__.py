"""Column expressions and ordered-series building blocks."""
