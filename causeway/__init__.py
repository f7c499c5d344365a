"""Spark-native engine for directed influence between time series."""

__version__ = "0.1.0"
