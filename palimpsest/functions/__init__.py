"""Column expressions: text, hashing, parsing."""
