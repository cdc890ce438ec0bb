"""A PySpark-native engine for typed facts."""
