"""Column expressions: text, numbers, labels, prompts."""
