"""Column functions over bytes, paths and reports, and their SQL registration."""
