"""Column expressions and small DataFrame helpers used by the operators."""
