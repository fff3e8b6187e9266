"""Spark-native host-provenance analytics."""
