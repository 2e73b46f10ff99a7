"""Spark-native text reduction and retrieval analytics."""
