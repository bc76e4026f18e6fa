"""A PySpark-native engine for comparing two versions of a layered SQL-transformation project."""
