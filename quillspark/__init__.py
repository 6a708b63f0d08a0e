"""Spark-native analytics for document and event pipelines."""
