"""Reading and writing dated and plain tables, and role views over the test tables."""
