"""Spark-native analytics for ordered event logs (ball-by-ball match data as the model case)."""
