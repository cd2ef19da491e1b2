"""A PySpark-native engine for chunked, multi-resolution array data."""
