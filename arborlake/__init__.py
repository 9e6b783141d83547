"""Spark-native analytics over collections of file trees held as tables."""
