"""Spark-native multiple-alignment analytics."""
