"""Column expressions; nothing here reads data."""
