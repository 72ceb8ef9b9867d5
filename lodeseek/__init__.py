"""Spark-native retrieval analytics: scan, diff, chunk, store, search and graph over DataFrames."""
