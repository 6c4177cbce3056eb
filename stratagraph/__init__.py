"""Spark-native analytics over code-architecture graphs."""
