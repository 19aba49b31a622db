"""Spark-native bundle recommendation and basket analytics."""
