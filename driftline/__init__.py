"""Spark-native analysis of keyed position reports: traces, windows, features, clusters and paths."""
