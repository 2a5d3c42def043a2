"""Spark-native analysis of controlled experiments."""
