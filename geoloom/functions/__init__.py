"""Column expressions of plane geometry."""
