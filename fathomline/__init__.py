"""Spark-native retrieval, grounding and evaluation engine."""
