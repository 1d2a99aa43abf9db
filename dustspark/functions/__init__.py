"""Column expressions: pure functions of columns, no Python in the row path."""
