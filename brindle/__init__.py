"""Spark-native associative analytics: ordered names, typed records, graphs, recall and prediction."""
