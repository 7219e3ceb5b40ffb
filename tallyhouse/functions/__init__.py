"""Column functions: cleaning, casting, safe arithmetic, names and formulas."""
