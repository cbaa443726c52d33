"""Column expressions and small helpers that run inside tasks."""
