"""Spark-native analytics of recordings, events and periods."""
