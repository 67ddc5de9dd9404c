"""Spark-native analytics for sensor telemetry and the operations data around it."""
