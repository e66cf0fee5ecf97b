"""Spark-native analytics for the early life and long-term survival of software repositories."""
