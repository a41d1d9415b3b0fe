"""Column expressions on sequences and headers."""
