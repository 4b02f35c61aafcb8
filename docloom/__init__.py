"""Spark-native document-extraction analytics."""
