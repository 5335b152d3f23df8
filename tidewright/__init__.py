"""Spark-native interval, matching and decision analytics."""
