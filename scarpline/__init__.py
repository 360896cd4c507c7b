"""Spark-native terrain, rainfall and time-series analytics."""
