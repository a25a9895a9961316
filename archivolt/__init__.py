"""A PySpark-native engine for building, indexing, searching and scoring document collections."""
