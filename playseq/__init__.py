"""Spark-native analysis of sequential play in repeated two-player games."""
