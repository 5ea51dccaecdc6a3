"""Spark-native spatial-index lab."""
