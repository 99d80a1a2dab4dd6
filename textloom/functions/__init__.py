"""Column expressions and pure-Python code metrics."""
