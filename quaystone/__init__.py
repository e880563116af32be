"""Spark-native analytics for retrieval, grounding and answer verification."""
