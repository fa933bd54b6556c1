"""Spark-native engine for mining reviews against roadmaps."""
