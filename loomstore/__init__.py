"""Spark-native analytics over semantic-memory tables."""
