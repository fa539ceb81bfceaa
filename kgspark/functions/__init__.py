"""Column functions: everything here is a Catalyst expression, no Python runs per row."""
