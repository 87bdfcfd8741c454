"""A PySpark-native program-analysis and corpus engine."""
