"""Column expressions: text, URLs and bounded scores."""
