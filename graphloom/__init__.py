"""Spark-native hybrid graph retrieval and analytics."""
