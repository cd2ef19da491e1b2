"""Array operations as DataFrame operations."""
