"""A PySpark-native engine for checking generated answers against their sources."""
