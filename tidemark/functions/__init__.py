"""Column expressions and small DataFrame helpers that the operators share."""
