"""Column expressions and model providers."""
