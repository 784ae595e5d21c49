"""Column functions: no joins, no shuffles, safe to use in any projection."""
