"""Spark-native analytics for building and auditing text-evaluation data."""
