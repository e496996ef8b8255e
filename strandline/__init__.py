"""Spark-native analytics for ensembles of time-ordered, high-dimensional observations."""
