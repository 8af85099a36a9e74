"""Spark-native analytics over a research library: records, pages, notes, vectors."""
