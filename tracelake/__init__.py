"""Spark-native analytics for recorded action trajectories."""

__version__ = "0.1.0"
