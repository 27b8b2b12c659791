"""Spark-native evidence-graph and corpus engine."""
