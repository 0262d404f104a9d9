"""Spark-native analytics for evaluating retrieval systems over a corpus and its citation graph."""
