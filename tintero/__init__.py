"""Spark-native analysis of a corpus of official documents."""
