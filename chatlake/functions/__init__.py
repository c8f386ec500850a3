"""Column functions: pure expressions, no Python workers unless the docstring says so."""
