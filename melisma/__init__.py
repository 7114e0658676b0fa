"""Melisma: a Spark-native analytics engine for prosodic and other time series."""
