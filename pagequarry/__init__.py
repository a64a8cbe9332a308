"""Spark-native analytics for corpora of generated web pages and their evaluation records."""
