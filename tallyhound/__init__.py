"""Spark-native financial-crime analytics engine."""
