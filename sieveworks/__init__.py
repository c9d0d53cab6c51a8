"""Spark-native analytics on how redundant, structured and compressible a corpus is."""
