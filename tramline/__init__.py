"""A PySpark-native engine for public-transport data."""
