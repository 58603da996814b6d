"""Spark-native analytics for ordered price bars and document corpora."""
