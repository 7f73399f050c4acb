"""Spark-native site audit engine and training-data operators."""
