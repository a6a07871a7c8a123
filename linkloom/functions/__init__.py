"""Column functions: text, addresses, similarity."""
