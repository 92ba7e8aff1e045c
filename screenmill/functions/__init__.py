"""Column functions: they take and return Column."""
