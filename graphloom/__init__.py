"""Spark-native analytics over code graphs and training-data tables."""
