"""Spark-native analytics over collections of documents."""
