"""Spark-native structural analytics engine."""
