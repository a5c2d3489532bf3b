"""Column expressions and helpers over plain tables."""
