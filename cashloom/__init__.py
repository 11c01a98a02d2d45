"""Spark-native reconciliation analytics."""
