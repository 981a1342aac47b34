"""Spark-native analytics for media clips, word timings, metric snapshots and job events."""
