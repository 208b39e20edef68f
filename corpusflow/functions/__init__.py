"""Column functions: everything here is a plain Catalyst expression."""
