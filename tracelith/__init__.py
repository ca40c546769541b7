"""Spark-native analytics for vehicle message traces and large document corpora."""
