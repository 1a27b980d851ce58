"""Palimpsest: Spark-native analytics over versioned, layered documents."""
