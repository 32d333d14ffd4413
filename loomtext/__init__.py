"""Spark-native curation and evaluation of parallel text."""
