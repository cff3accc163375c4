"""A PySpark-native document indexing and term lookup engine."""
