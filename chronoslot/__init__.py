"""PySpark-native trace analytics engine."""
