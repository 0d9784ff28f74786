"""Spark-native text compression, retrieval, governance and savings analytics."""
