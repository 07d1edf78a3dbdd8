"""PySpark-native engine for evidence-backed records."""
